"""Chunks and sentences of documents.

split_documents() cuts texts recursively at the separators into chunks of at most `size` characters that overlap by up to
`overlap`; sentence_spans() and sentence_index() find sentence spans in any text column as built-in expressions, text by text; chunk_offsets() gives the
running estimate of a chunk's place, also without Python.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, rtrim_ws

SIZE, OVERLAP = 1500, 750
#: From the coarsest separator to single characters.
SEPARATORS = ("\n\n", "\n", ".", " ", "")
#: One or more end marks, perhaps a closing quote, then white space; or an empty line.
BOUNDARY = rf"([.!?]+[\"”']?{WS}+|\n{{2,}})"


def _pieces(text: str, a: int, b: int, separator: str) -> list[tuple[int, int]]:
    """Spans that begin with the separator, but for the first one."""
    if not separator:
        return [(i, i + 1) for i in range(a, b)]
    cuts = [a]
    at = text.find(separator, a, b)
    while at >= 0:
        cuts.append(at)
        at = text.find(separator, at + len(separator), b)
    return [(x, y) for x, y in zip(cuts, [*cuts[1:], b], strict=True) if x < y]


def _merge(text: str, pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Packs pieces that follow each other into spans of at most `size`, keeping whole pieces of at most `overlap` for the next."""

    def stripped() -> Iterator[tuple[int, int]]:
        a, b = held[0][0], held[-1][1]
        part = text[a:b]
        a += len(part) - len(part.lstrip())
        b -= len(part) - len(part.rstrip())
        if a < b:
            yield a, b

    held: deque[tuple[int, int]] = deque()
    total = 0
    for a, b in pieces:
        n = b - a
        if total + n > size and held:
            yield from stripped()
            while held and (total > overlap or total + n > size):
                x, y = held.popleft()
                total -= y - x
        held.append((a, b))
        total += n
    if held:
        yield from stripped()


def split_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS, a: int = 0, b: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of text[a:b]."""
    b = len(text) if b is None else b
    k = next((i for i, s in enumerate(separators) if not s or text.find(s, a, b) >= 0), len(separators) - 1)
    rest = separators[k + 1 :]
    good: list[tuple[int, int]] = []
    for x, y in _pieces(text, a, b, separators[k]):
        if y - x < size:
            good.append((x, y))
            continue
        if good:
            yield from _merge(text, good, size, overlap)
            good = []
        if rest:
            yield from split_spans(text, size, overlap, rest, x, y)
        else:
            yield x, y
    if good:
        yield from _merge(text, good, size, overlap)


def chunk_offsets(rows: DataFrame, by: Sequence[str], order: str, length: str | Column, overlap: int = OVERLAP) -> DataFrame:
    """Adds start_idx and end_idx by the recurrence end = start + length, next start = max(0, end - overlap).

    That walk, reflected at 0, is the running sum of the steps less its least value so far.
    """
    n = F.col(length) if isinstance(length, str) else length
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_walk", F.coalesce(F.sum(n - overlap).over(before), F.lit(0)))
    start = F.col("_walk") - F.least(F.lit(0), F.min("_walk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("start_idx", start.cast("int")).withColumn("end_idx", (F.col("start_idx") + n).cast("int")).drop("_walk")


def split_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk_id, doc_id, chunk_no, text, start_idx, end_idx, true_start); null and blank texts have no chunks.

    start_idx and end_idx are those of chunk_offsets(), told where a document is split: nothing is shuffled."""
    pairs = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "chunk_no": [], "text": [], "start_idx": [], "end_idx": [], "true_start": []}
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                end = overlap
                for i, (a, b) in enumerate(split_spans(t or "", size, overlap)):
                    start = max(0, end - overlap)
                    end = start + b - a
                    for values, value in zip(out.values(), (d, i, t[a:b], start, end, a), strict=True):
                        values.append(value)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    found = pairs.mapInArrow(run, "doc_id string, chunk_no int, text string, start_idx int, end_idx int, true_start int")
    return found.select(F.concat_ws("_", "doc_id", "chunk_no").alias("chunk_id"), "doc_id", "chunk_no", "text", "start_idx", "end_idx", "true_start")


def parts_of(text: Column) -> Column:
    """Boundaries become a control character, which is split at."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x01", "\ufffd"), "(?U)" + BOUNDARY, "$1\x01")
    return F.split(marked, "\x01", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(values: Column, block: int = 64) -> Column:
    """For each value of an array the sum of those before it, by sums of blocks: a long array costs its length, not its square."""
    plus = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    whole = lambda i: F.floor(i / block).cast("int")

    def by_blocks(v: Column) -> Column:
        last = whole(F.size(v) - 1)
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: plus(F.slice(v, b * block + 1, F.lit(block))))
        before = let(sums, lambda t: F.transform(F.sequence(F.lit(0), last), lambda b: plus(F.slice(t, F.lit(1), b))))
        return let(before, lambda t: F.transform(v, lambda _, i: F.get(t, whole(i)) + plus(F.slice(v, whole(i) * block + 1, i % block))))

    return let(values, by_blocks)


def numbered_spans(parts: Column) -> Column:
    """array<struct<sent_id, start, end, part>>: the sentences among the parts of a text, each with the index of its part."""
    starts = sums_before(F.transform(parts, lambda p: F.length(p)))
    found = F.zip_with(parts, starts, lambda p, s: F.struct(s.alias("start"), (s + F.length(rtrim_ws(p))).alias("end")))
    placed = F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("part")))
    filled = F.filter(placed, lambda x: x["end"] > x["start"])
    return F.transform(filled, lambda x, i: F.struct(i.alias("sent_id"), x["start"].alias("start"), x["end"].alias("end"), x["part"].alias("part")))


def sentence_spans(text: Column) -> Column:
    """array<struct<sent_id, start, end>>: half-open spans in characters.

    The lengths of the parts between boundaries add up to the spans. A span keeps its leading white space and loses the trailing
    one; parts of white space only have no number.
    """
    return F.transform(let(parts_of(text), numbered_spans), lambda x: F.struct(x["sent_id"].alias("sent_id"), x["start"].alias("start"), x["end"].alias("end")))


def sentence_windows(text: Column, size: int = 1) -> Column:
    """array<struct<sent_id, start, end, n_sents, text>>: each sentence with its neighbours up to `size` away.

    Windows are put together from the parts, so that a long text is not searched for each; U+0001 reads as U+FFFD there."""
    def cut_out(parts: Column, k: Column, w: Column) -> Column:
        first, last = F.get(w, F.lit(0)), F.element_at(w, -1)
        whole = rtrim_ws(F.array_join(F.slice(parts, first["part"] + 1, last["part"] - first["part"] + 1), ""))
        return F.struct(k.alias("sent_id"), first["start"].alias("start"), last["end"].alias("end"), F.size(w).alias("n_sents"), whole.alias("text"))

    def near(index: Column, k: Column) -> Column:
        lo = F.greatest(F.lit(0), k - size)
        return F.slice(index, lo + 1, F.least(F.size(index), k + size + 1) - lo)

    def windows(parts: Column) -> Column:
        return let(numbered_spans(parts), lambda index: F.transform(index, lambda s: let(near(index, s["sent_id"]), lambda w: cut_out(parts, s["sent_id"], w))))

    return let(parts_of(text), windows)


def sentence_index(rows: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(*by, sent_id, start, end): a row for each sentence of each text; nothing is shuffled."""
    return rows.select(*by, F.explode(sentence_spans(F.col(text))).alias("_s")).select(*by, "_s.sent_id", "_s.start", "_s.end")


def with_sentences(chunks: DataFrame) -> DataFrame:
    """Adds sent_index (array<struct<sent_id, start, end>>) to chunks, in place; empty where there is no sentence."""
    return chunks.withColumn("sent_index", sentence_spans(F.col("text")))


def chunks_with_sentences(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks and their sentences in one pass without a shuffle; works on streams too."""
    return with_sentences(split_documents(docs, size, overlap))
