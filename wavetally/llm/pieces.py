"""Unigram segmentation into pieces: Viterbi over a double-array trie, with byte fallback, and its inverse.

A model is a list of pieces with log scores. Text is marked first: spaces become the marker U+2581, and one marker
leads the text. The best sum of scores wins; of equal sums the one whose last piece is longest. Characters that no
piece covers become bytes. Decoding joins the pieces, turns markers into spaces and drops the leading one, so every
text comes back as it was; a marker character that the text itself holds is encoded as bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.tables import in_small_batches

MARKER = "▁"
#: Half a surrogate pair, which no UTF-8 text holds, stands for a marker in the text itself while that is cut.
_LITERAL = "\ud800"
#: Words up to this length are segmented together; longer ones, such as text without spaces, one by one.
SHORT = 48
#: Words of one task are remembered up to so many bytes of words and ids, then all are forgotten.
REMEMBERED = 20_000_000
#: What a remembered word takes besides its letters and ids: objects and its place in the dictionary.
_OVERHEAD = 200
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]  # of the pieces; ignored for those that are not text
    byte_ids: list[int]  # of the 256 byte pieces
    text_ids: list[int]  # of pieces that are text
    trie: Trie = field(init=False)

    def __post_init__(self):
        self.trie = Trie([(self.pieces[i], i) for i in self.text_ids])
        self.score = np.array(self.scores, np.float64)
        #: A character in bytes costs more than any piece: bytes serve only where no piece does.
        self.byte_score = min((self.scores[i] for i in self.text_ids), default=0.0) - 10.0
        marked = [self.pieces[i].lstrip(MARKER) for i in self.text_ids]
        if any(MARKER in p for p in marked):
            raise ValueError("a piece with a marker after text: words can't be cut apart")
        self.decoded = [p.replace(MARKER, " ") for p in self.pieces]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def read_model(path: str = MODEL) -> Model:
    """Pieces and scores of a SentencePiece model file.

    Files of merge order hold ranks (0, -1, -2, ...) for scores. Such ranks are turned into log probabilities by
    Zipf's law, -log(rank + 2); files of a unigram model are taken as they are.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    text = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    scores = [p.get_score(i) for i in range(n)]
    if all(float(scores[i]).is_integer() for i in text):
        scores = [float(-np.log(2.0 - s)) if s <= 0 else s for s in scores]
    bytes_ = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Model([p.id_to_piece(i) for i in range(n)], scores, bytes_, text)


class Trie:
    """A double-array trie: from state s by character code c to base[s] + c, if check there is s."""

    def __init__(self, entries: list[tuple[str, int]]):
        letters = sorted({c for p, _ in entries for c in p})
        self.alphabet = np.array([ord(c) for c in letters], np.int64)
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.longest = max((len(p) for p, _ in entries), default=0)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, i in entries:
            node = 0
            for c in piece:
                step = children[node].get(code[c])
                if step is None:
                    step = len(children)
                    children[node][code[c]] = step
                    children.append({})
                node = step
            ends[node] = i
        # a node's children lie within one alphabet's width of the first free place
        size = len(children) + 2 * len(letters) + 2
        base, check, value = (np.full(size, x, np.int64) for x in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0] = True
        low = 1
        place = {0: 0}
        todo = [0]
        while todo:
            node = todo.pop()
            at = place[node]
            value[at] = ends.get(node, -1)
            if not children[node]:
                continue
            codes = np.array(sorted(children[node]))
            while used[low]:
                low += 1
            b = max(0, low - int(codes[0]))
            while used[b + codes].any():
                b += 1
            base[at] = b
            for c in codes.tolist():
                used[b + c] = True
                check[b + c] = at
                place[children[node][c]] = b + c
                todo.append(children[node][c])
        self.base, self.check, self.value = base, check, value

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Of code points; 0 for characters of no piece."""
        if not len(self.alphabet):
            return np.zeros(len(points), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)


def _matches(trie: Trie, points: np.ndarray, word_end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, starts and ids of the pieces found there; every start walks the trie at the same time."""
    codes = np.concatenate([trie.codes(points), [0]])
    alive = np.arange(len(points))
    state = np.zeros(len(points), np.int64)
    found = []
    for step in range(trie.longest):
        inside = alive + step < word_end[alive]
        alive, state = alive[inside], state[inside]
        code = codes[alive + step]
        to = trie.base[state] + code
        good = (code > 0) & (trie.check[to] == state)
        alive, state = alive[good], to[good]
        if not len(alive):
            break
        ends = trie.value[state] >= 0
        found.append((alive[ends], trie.value[state[ends]]))
    return found


def segment(model: Model, words: list[str]) -> list[bytes]:
    """Token ids of each word, as 32-bit integers in the machine's order."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    matches = _matches(model.trie, points, np.repeat(starts[1:], lengths))
    forward = _together if lengths.max(initial=0) <= SHORT else _one_by_one
    return _backward(model, words, starts, *forward(model, lengths, starts, matches))


def _together(model: Model, lengths, starts, matches) -> tuple[list[int], list[int]]:
    """Length and id (-1: bytes) of the last piece of the best way to each place; all words advance in step.

    Word w has the places starts[w] + w (its start) to starts[w + 1] + w (its end).
    """
    n, words = int(starts[-1]), len(lengths)
    slot = np.arange(n) + np.repeat(np.arange(words), lengths)
    best = np.full(n + words, -np.inf)
    best[starts[:-1] + np.arange(words)] = 0.0
    last_len = np.ones(n + words, np.int64)
    last_id = np.full(n + words, -1, np.int64)
    table = np.full((len(matches), n), -1, np.int64)
    for size, (at, ids) in enumerate(matches):
        table[size, at] = ids
    offset = np.arange(n) - np.repeat(starts[:-1], lengths)
    order = np.argsort(offset, kind="stable")
    cuts = np.searchsorted(offset[order], np.arange(int(lengths.max(initial=0)) + 1))

    def offer(to, value, size, ids):
        better = (value > best[to]) | ((value == best[to]) & (size > last_len[to]))
        to = to[better]
        best[to], last_len[to], last_id[to] = value[better], size, ids[better]

    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        here = best[slot[at]]
        offer(slot[at] + 1, here + model.byte_score, 1, np.full(len(at), -1))
        for size in range(1, len(matches) + 1):
            ids = table[size - 1, at]
            hit = ids >= 0
            if hit.any():
                offer(slot[at[hit]] + size, here[hit] + model.score[ids[hit]], size, ids[hit])
    return last_len.tolist(), last_id.tolist()


def _one_by_one(model: Model, lengths, starts, matches) -> tuple[list[int], list[int]]:
    """As ``_together``, place after place."""
    n, words = int(starts[-1]), len(lengths)
    sizes = np.concatenate([np.full(len(at), size + 1) for size, (at, _) in enumerate(matches)] or [np.zeros(0, int)])
    at = np.concatenate([at for at, _ in matches] or [np.zeros(0, int)])
    ids = np.concatenate([ids for _, ids in matches] or [np.zeros(0, int)])
    order = np.lexsort((sizes, at))
    found = zip(at[order].tolist(), sizes[order].tolist(), ids[order].tolist(), model.score[ids[order]].tolist())
    last_len, last_id = [1] * (n + words), [-1] * (n + words)
    nothing = (n, 0, 0, 0.0)
    match = next(found, nothing)
    for w in range(words):
        best = [0.0] + [float("-inf")] * int(lengths[w])
        place = int(starts[w]) + w
        for o in range(int(lengths[w])):
            here = best[o]
            offers = [(1, -1, here + model.byte_score)]
            while match[0] == place - w + o:
                offers.append((match[1], match[2], here + match[3]))
                match = next(found, nothing)
            for size, i, value in offers:
                if value > best[o + size] or value == best[o + size] and size > last_len[place + o + size]:
                    best[o + size] = value
                    last_len[place + o + size], last_id[place + o + size] = size, i
    return last_len, last_id


def _backward(model: Model, words, starts, lens, ids) -> list[bytes]:
    out = []
    for w, word in enumerate(words):
        base = int(starts[w]) + w
        at, tokens = len(word), []
        while at > 0:
            i = ids[base + at]
            if i >= 0:
                tokens.append(i)
            else:
                c = word[at - 1]
                tokens += [model.byte_ids[b] for b in reversed((MARKER if c == _LITERAL else c).encode())]
            at -= lens[base + at]
        out.append(array("i", tokens[::-1]).tobytes())
    return out


# runs of markers with the text up to the next: no piece crosses such a cut
_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
#: Characters that are segmented in one go; they bound a worker's memory.
_PORTION = 50_000


class Encoder:
    """Encodes texts and remembers the words it has met, within a bound of bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, words: Iterable[str]) -> None:
        def add(todo: list[str]) -> None:
            ids = segment(self.model, todo)
            self.known.update(zip(todo, ids))
            self.held += sum(_OVERHEAD + len(w) + len(i) for w, i in zip(todo, ids))

        todo, size = [], 0
        for w in words:
            todo.append(w)
            size += len(w)
            if size > _PORTION:
                add(todo)
                todo, size = [], 0
        if todo:
            add(todo)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray | None]:
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        cut: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if text is None:
                cut.append(None)
                continue
            marked = (MARKER + text.replace(MARKER, _LITERAL)).replace(" ", MARKER)
            words = _WORD.findall(marked) if text else []
            cut.append(words)
            new.update(words)
        new.difference_update(self.known)
        self._learn(w for w in new if len(w) <= SHORT)
        self._learn(w for w in new if len(w) > SHORT)
        get = self.known.__getitem__
        return [None if w is None else np.frombuffer(b"".join(map(get, w)), np.int32) for w in cut]


def decode(model: Model, ids: Iterable[int]) -> str:
    """The text of token ids: bytes joined, markers turned into spaces, the leading one dropped."""
    ids = list(ids)
    text, byte_of = model.decoded, model.byte_of
    if byte_of.keys().isdisjoint(ids):
        out = "".join(map(text.__getitem__, ids))
    else:
        out = b"".join(byte_of[i] if i in byte_of else text[i].encode() for i in ids).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        t = t.as_py()
        part.append(t)
        size += 0 if t is None else len(t)
        if size > 4 * _PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    offsets = np.cumsum([0, *(0 if v is None else len(v) for v in values)]).astype(np.int32)
    flat = [v for v in values if v is not None]
    nulls = pa.array([v is None for v in values] + [False])
    lists = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, mask=nulls.to_numpy(zero_copy_only=False)), lists)


def encode_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, ids ARRAY<INT>, n_tokens, n_bytes, round_trip`` of every document, and its ``decoded`` text.

    ``n_bytes`` counts byte pieces; ``round_trip`` says whether the decoded text equals the text, ``decoded`` is it.
    A null text has null ids, no tokens and a null decoded text, an empty one no tokens. Rows are independent: nothing
    moves but the model, whose pieces (a fixed vocabulary) go to every worker once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        encoder = Encoder(m)
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[m.byte_ids] = True
        for batch in batches:
            done = 0
            for texts in _portions(batch.column("text")):
                ids = encoder.encode(texts)
                back = [None if v is None else decode(m, v.tolist()) for v in ids]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, n),
                        _lists(ids),
                        pa.array([0 if v is None else len(v) for v in ids], pa.int64()),
                        pa.array([0 if v is None else int(is_byte[v].sum()) for v in ids], pa.int64()),
                        pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                        pa.array(back, pa.string()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "n_bytes", "round_trip", "decoded"],
                )
                done += n

    schema = f"doc_id {kind}, ids array<int>, n_tokens bigint, n_bytes bigint, round_trip boolean, decoded string"
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    back = F.udf(lambda ids: None if ids is None else decode(shared.value, ids), "string", useArrow=True)
    return tokens.select("doc_id", back("ids").alias("text"))
