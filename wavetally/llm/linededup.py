"""Lines that recur from document to document, found as templates in a tree.

The tree has fixed depth: token count, then the leading tokens. Below such a leaf a line belongs to its exact
sequence of tokens, in which tokens with digits are variable from ``LEAST_TOKENS`` tokens on, and, from ``GENERAL_TOKENS`` tokens on, to one template
for each of ``FIELDS`` equal stretches of what follows the leading tokens, with that stretch variable. Lines of one
template differ in the variable fields only. All of a line's templates come from the line alone, so no leaf is ever
gathered in one place and the order of lines does not matter.

Tokens are cut at white space; in scripts written without it (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each
character is a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wavetally.llm.tables import fresh, in_small_batches, saved, small

#: Leading tokens that are levels of the tree.
DEPTH = 3
FIELDS = 4
#: In shorter lines tokens with digits are not variable, as too little else is left.
LEAST_TOKENS = 5
#: Shorter lines have no variable stretch, only variable tokens.
GENERAL_TOKENS = 10
_DIGIT = re.compile(rb"[0-9]")
#: One UTF-8 character of a script without spaces: Thai and Lao, Burmese and Khmer, kana and Han.
_UNSPACED = re.compile(
    rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}"
    rb"|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}"
)


def line_tokens(line: bytes) -> list[bytes]:
    """The line's tokens; those with digits are ``<*>`` unless there are few."""
    tokens = (line if line.isascii() else _UNSPACED.sub(rb" \g<0> ", line)).split()
    if len(tokens) < LEAST_TOKENS or not _DIGIT.search(line):
        return tokens
    return [b"<*>" if _DIGIT.search(t) else t for t in tokens]


def line_templates(tokens: list[bytes]) -> list[bytes]:
    """The templates of a line as text, exact one first; none if it is blank."""
    n = len(tokens)
    if not n:
        return []
    head = b"%d " % n + b" ".join(tokens[:DEPTH])
    rest = tokens[DEPTH:]
    out = [head + b" " + b" ".join(rest)]
    if n >= GENERAL_TOKENS:
        cuts = [len(rest) * i // FIELDS for i in range(FIELDS + 1)]
        parts = [b" ".join(rest[a:b]) for a, b in zip(cuts, cuts[1:])]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append(b" ".join([head, *parts[:i], b" ".join([b"<*>"] * (b - a)), *parts[i + 1 :]]))
    return out


def _lines(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, lines, templates = [], [], [], []

            def rows():
                columns = [pa.array(ids, kind), pa.array(own, pa.int64()), pa.array(lines, pa.int32()), pa.array(templates, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "line", "template"])

            hashes = batch.column("text_hash").to_pylist()
            for doc_id, h, text in zip(batch.column("doc_id").to_pylist(), hashes, batch.column("text")):
                for i, line in enumerate((text.as_py() or b"").split(b"\n")):
                    for t in line_templates(line_tokens(line)):
                        ids.append(doc_id)
                        own.append(h)
                        lines.append(i)
                        templates.append(xxh3_64_intdigest(t) - (1 << 63))
                if len(ids) > 100_000:
                    yield rows()
                    ids, own, lines, templates = [], [], [], []
            yield rows()

    return run


def recurring_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, lines ARRAY<INT>``: the lines (from 0, cut at newlines) of each document's text to drop.

    A line goes if one of its templates also occurs in a document of smaller id; the first document with a template
    keeps it. Documents are told apart by id, so rows of one id keep what recurs among themselves only; line numbers
    belong to a text (its ``xxhash64``), as such rows may hold different ones. Rows without an id have no part.
    Templates meet in an aggregate (first and last id of each) and a join on 64-bit hashes, both of which Spark
    splits for hot templates; a document's lines to drop are gathered per document.
    """
    kind = pa.int32() if dict(docs.dtypes)["doc_id"] == "int" else pa.int64()
    narrow = in_small_batches(docs).filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")
    )
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, line int, template bigint"
    rows = narrow.mapInArrow(_lines(kind), schema)
    span = rows.groupBy("template").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = span.filter("first < last").select("template", "first")
    again = rows.join(shared, "template").filter("doc_id > first")
    return again.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _without(texts: pd.Series, lines: pd.Series) -> pd.Series:
    out = []
    for text, drop in zip(texts, lines):
        if text is None or drop is None:
            out.append(text)
            continue
        gone = set(drop)
        out.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def drop_recurring(docs: DataFrame, name: str = "dropped") -> DataFrame:
    """``docs`` without its recurring lines in ``text``, and a last column with their number.

    That column is called ``name`` (underscores lead it where that is taken). Null texts stay null; all rows stay,
    also those of which nothing is left. The lists of lines go to every executor if their size is within a bound,
    else documents and lists meet in a shuffle.
    """
    name = fresh(docs, name)
    lists = saved(recurring_lines(docs), "lines")
    size = lists.agg(F.coalesce(F.sum(24 + 4 * F.size("lines")), F.lit(0))).first()[0]
    key, own, gone = (fresh(docs, n) for n in ("of", "own", "gone"))
    found = lists.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own), F.col("lines").alias(gone))
    same = (docs["doc_id"] == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(own))
    joined = docs.join(small(found, size), same, "left").drop(key, own)
    # else a filter on the new text runs it once more below, in a second Python worker of the same task
    without = F.pandas_udf(_without, "string").asNondeterministic()
    return joined.withColumns({"text": without("text", gone), name: F.coalesce(F.size(gone), F.lit(0)).cast("bigint")}).drop(gone)
