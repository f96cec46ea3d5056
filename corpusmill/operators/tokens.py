"""Token streams: spans, segments, blocks, lanes and targets.

Words of a line or document stay in one row as long as that goes: blocks are put together from slices of their arrays, not from single tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running_sum


def word_spans(corpus: DataFrame, length: Column | None = None, key: str = "pos") -> DataFrame:
    """key, word_no, word, start, end: half-open spans in units of length (characters and one separator by default).

    Rows are dealt out by key before their words are, so that no word is shuffled.
    """
    rows = corpus.repartition(key).select(key, F.posexplode("words").alias("word_no", "word"))
    size = F.length("word") + 1 if length is None else length
    here = Window.partitionBy(key).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(here), F.lit(0))
    return rows.select(key, "word_no", "word", start.alias("start"), (start + F.length("word")).alias("end"))


def segments(tokens: DataFrame, stream: str, order: list[str], is_end: Column) -> DataFrame:
    """tokens with segment, the number from 0 of the part of the stream between end marks."""
    before = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("segment", F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)))


def placed(rows: DataFrame, tokens: str = "words") -> DataFrame:
    """pos, the tokens as words, at (how many tokens of the stream lie before) and n_stream (tokens in all) of the stream that the rows make in order of pos, which tells them apart.

    Only pos and the number of tokens go through the order; the token arrays are joined to that once.
    """
    whole = rows.select("pos", F.col(tokens).alias("words"))
    at = running_sum(whole.select("pos", F.size("words").cast("long").alias("_n")), "pos", "_n", "at", total="n_stream")
    return whole.join(at.drop("_n"), "pos")


def positions(rows: DataFrame, tokens: str = "words") -> DataFrame:
    """g, pos, token_no, token and n_stream (tokens in all) of the stream that the rows' token arrays make in order of pos."""
    flat = placed(rows, tokens).select("pos", "at", "n_stream", F.posexplode("words").alias("token_no", "token"))
    return flat.select((F.col("at") + F.col("token_no")).alias("g"), "pos", "token_no", "token", "n_stream")


def slices(stream: DataFrame, size: int, keep_rest: bool = False) -> DataFrame:
    """block_id, at (in the stream), pos and tokens: what each row of placed() has of each block of size tokens.

    What doesn't fill a block is dropped unless keep_rest.
    """
    n = F.size("words")
    ends = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + n - 1) / size))
    each = stream.where(n > 0).select("pos", "at", "words", "n_stream", F.explode(ends).alias("block_id"))
    first = F.greatest(F.col("block_id") * size - F.col("at"), F.lit(0))
    last = F.least((F.col("block_id") + 1) * size - F.col("at"), n.cast("long"))
    cut = F.slice("words", (first + 1).cast("int"), (last - first).cast("int"))
    rows = each.select("block_id", (F.col("at") + first).alias("at"), "pos", cut.alias("tokens"), "n_stream")
    return (rows if keep_rest else rows.where(F.col("block_id") < F.floor(F.col("n_stream") / size))).drop("n_stream")


def packed(stream: DataFrame, size: int, masked: str | int | None = None, mask: str | int | None = None, keep_rest: bool = False) -> DataFrame:
    """block_id, n_rows, input_ids and labels of each full block; in labels mask (null by default) stands where the token is masked."""
    rows = slices(stream, size, keep_rest).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("_s"))
    ids = F.flatten(F.transform("_s", lambda s: s["tokens"]))
    labels = ids if masked is None else F.transform(ids, lambda t: F.when(t != masked, t).otherwise(F.lit(mask)))
    return rows.select("block_id", F.size("_s").cast("long").alias("n_rows"), ids.alias("input_ids"), labels.alias("labels"))


def packed_in_batches(rows: DataFrame, size: int, batch_rows: int = 1000, tokens: str = "words") -> DataFrame:
    """Blocks as they come out if each batch of rows (in order of pos, row numbers in row_no) is packed by itself and its rest dropped: batch, block, tokens.

    A batch is a bounded number of rows, put together as one array.
    """
    batch = F.floor(F.col("row_no") / batch_rows)
    whole = rows.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("row_no", F.col(tokens).alias("t")))).alias("_r"))
    flat = whole.select("batch", F.flatten(F.transform("_r", lambda r: r["t"])).alias("t")).where(F.size("t") >= size)
    numbers = F.sequence(F.lit(0), F.floor(F.size("t") / size).cast("int") - 1)
    return flat.select("batch", "t", F.explode(numbers).alias("block")).select("batch", "block", F.slice("t", F.col("block") * size + 1, F.lit(size)).alias("tokens"))


def lanes(stream: DataFrame, n_lanes: int) -> DataFrame:
    """stream cut into n_lanes equal lanes, lane and t (place in it); the rest at the end is dropped."""
    length = F.floor(F.col("n_stream") / n_lanes)
    rows = stream.withColumn("_len", length).where(F.col("g") < F.col("_len") * n_lanes)
    return rows.select("g", "token", F.floor(F.col("g") / F.col("_len")).alias("lane"), (F.col("g") % F.col("_len")).alias("t"))


def pairs(words: Column | str, last: bool = False) -> Column:
    """(token, target) of each element of an array and the one after it; with last also the last one, whose target is null."""
    words = F.col(words) if isinstance(words, str) else words
    n = F.size(words)
    left = words if last else F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.arrays_zip(left.alias("token"), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("target"))


def targets(blocks: DataFrame, tokens: str = "input_ids") -> DataFrame:
    """block_id, token and target, the next token of the block (null at its end), of packed() blocks."""
    return blocks.select("block_id", F.inline(pairs(tokens, last=True)))
