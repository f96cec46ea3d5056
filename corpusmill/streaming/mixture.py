"""A weighted mixture of packed sources as one stateful operator over a stream of documents.

A source's documents are dealt to shards, each of which keeps its words, its texts that wait to be tokenised, and its place among the draws in
state of its own. The draws are those of operators/mixture.py: draw number b takes a source by the hash of b, so that every block's place in the
mixture is known without a word between the shards, and words come in proportion to the weights. The k-th draw of a source takes its
k-th block, which is block k // shards of shard k % shards.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.mixture import drawn, normalized
from ..operators.order import numbered
from ..operators.sampling import uniform

#: Tokens that a task gives out at a time, and texts and characters of a chunk of a queue.
TOGETHER, CHUNK_TEXTS, CHUNK_CHARS = 1 << 16, 64, 1 << 20
SCHEMA = "block_no long, source string, source_block long, tokens array<string>"
#: The state store that several state variables of a key need, and rows and bytes that come to a task at a time.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def split_words(texts: list[str]) -> list[list[str]]:
    return [t.split() for t in texts]


def _waiting(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """pos, source, compressed text and ended of a trigger's rows, the first by pos last, those without pos before all: what a task holds is less than the texts."""
    pressed, held = zstandard.ZstdCompressor(level=1).compress, []
    for frame in rows:
        for pos, source, text, ended in zip(*(frame[c] for c in ("pos", "source", "text", "ended")), strict=True):
            held.append((None if pd.isna(pos) else pos, source, None if text is None else pressed(text.encode()), bool(ended)))
    held.sort(key=lambda row: (row[0] is None, row[0] or 0))
    held.reverse()
    return held


def _text(pressed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(pressed).decode()


class Draws:
    """The draws that take a shard's blocks, in order."""

    def __init__(self, weights: dict[str, float], seed: int | str, shards: int):
        self.ends, self.seed, self.shards = [(name, round(end, 12)) for name, end in normalized(weights)], seed, shards

    def source(self, number: int) -> str:
        u = int(hashlib.md5(f"{self.seed}|{number}".encode()).hexdigest()[:13], 16) / (1 << 52)
        return next((name for name, end in self.ends[:-1] if u < end), self.ends[-1][0])

    def after(self, number: int, k: int, source: str, shard: int) -> tuple[int, int]:
        """The next draw from number on that takes a block of the shard, and which of its source's draws that is; k of these lie before number."""
        while True:
            if self.source(number) == source:
                if k % self.shards == shard:
                    return number, k
                k += 1
            number += 1


class Packing(StatefulProcessor):
    """The blocks of one shard of a source."""

    def __init__(self, draws: Draws, size: int, samples: int | None, together: int, tokenise: Callable[[list[str]], list[list[str]]], rest: bool):
        self.draws, self.size, self.samples, self.together, self.tokenise, self.with_rest = draws, size, samples, together, tokenise, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getValueState("words", "words array<string>")
        self.texts = handle.getListState("texts", "text string")
        self.place = handle.getValueState("place", "number long, k long, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        source, shard = key
        number, k, ended = self.place.get() if self.place.exists() else (0, 0, False)
        held = _waiting(rows)
        if ended:
            return
        words = list(self.words.get()[0]) if self.words.exists() else []
        texts = [t for (t,) in self.texts.get()] if self.texts.exists() else []
        out = []

        def give(tokens: list[str]) -> bool:
            nonlocal number, k
            number, k = self.draws.after(number, k, source, shard)
            if self.samples is not None and number >= self.samples:
                return False
            out.append((number, source, k, tokens))
            number, k = number + 1, k + 1
            return True

        def pack(ready: list[str]) -> bool:
            """Tokenises texts and gives what fills blocks; False when the cap is reached."""
            nonlocal words
            for tokens in self.tokenise(ready):
                words.extend(tokens)
            full = len(words) // self.size * self.size
            for at in range(0, full, self.size):
                if not give(words[at : at + self.size]):
                    return False
            words = words[full:]
            return True

        while held:
            _, _, text, last = held.pop()
            if text is not None:
                texts.append(_text(text))
            if last or len(texts) >= self.together:
                ready, texts = texts, []
                ended = not pack(ready) or last
                if last and self.with_rest and words and len(words) < self.size:
                    give(words)
                if len(out) * self.size >= TOGETHER:
                    yield pd.DataFrame(out, columns=["block_no", "source", "source_block", "tokens"])
                    out.clear()
                if ended:
                    break
        if ended:
            self.words.clear()
            self.texts.clear()
        else:
            self.words.update((words,))
            if texts:
                self.texts.put([(t,) for t in texts])
            else:
                self.texts.clear()
        self.place.update((number, k, ended))
        if out:
            yield pd.DataFrame(out, columns=["block_no", "source", "source_block", "tokens"])

    def close(self) -> None:
        pass


def packed_mixture(
    docs: DataFrame,
    weights: dict[str, float],
    size: int,
    seed: int | str,
    shards: int = 1,
    samples: int | None = None,
    together: int = 512,
    tokenise: Callable[[list[str]], list[list[str]]] = split_words,
    rest: bool = True,
) -> DataFrame:
    """block_no (the draw that takes the block), source, source_block and tokens of the blocks of size tokens that a stream of documents fills.

    docs is a stream with source, pos, text and ended. Documents of sources without a weight are left out. A shard's documents are taken in order of pos
    within a trigger, and trigger after trigger; a task holds what one trigger brings for a shard, compressed, which the source's options bound. together texts are
    tokenised at a time. A row with ended (see ends()) says that its shard has no more: what waits is tokenised, and with rest the
    words that don't fill a block are given as a last, shorter one, so that nothing is lost. With samples only the blocks of so many draws are given.
    """
    names = [name for name, _ in normalized(weights)]
    shard = F.coalesce(F.col("shard"), F.pmod(F.col("pos"), F.lit(shards))).cast("int") if "shard" in docs.columns else F.pmod(F.col("pos"), F.lit(shards)).cast("int")
    rows = docs.where(F.col("source").isin(names)).select("source", shard.alias("shard"), "pos", "text", F.coalesce("ended", F.lit(False)).alias("ended"))
    processor = Packing(Draws(weights, seed, shards), size, samples, together, tokenise, rest)
    return rows.groupBy("source", "shard").transformWithStateInPandas(processor, SCHEMA, "append", "None")


class SharedPacking(StatefulProcessor):
    """The blocks of one shard, whose sources share one buffer: each draw takes a document of a source.

    A source's k-th document in the shard belongs to the k-th draw of the source. So a source's documents stand in a queue, and the draws are gone through in
    order, as far as the one whose document isn't there yet. A queue lies in the state in chunks; one chunk of each is in memory.
    """

    def __init__(self, weights: dict[str, float], size: int, seed: int | str, samples: int | None, together: int, tokenise: Callable[[list[str]], list[list[str]]], rest: bool):
        self.weights, self.size, self.seed, self.samples, self.together, self.tokenise, self.with_rest = weights, size, seed, samples, together, tokenise, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getValueState("words", "words array<string>, blocks long, number long")
        self.texts = handle.getListState("texts", "text string")
        self.queues = handle.getMapState("queues", "source string, chunk long", "texts array<string>")
        self.sources = handle.getMapState("sources", "source string", "first long, next long, ended boolean")

    def _chunks(self, texts: deque[bytes]) -> Iterator[list[str]]:
        part, held = [], 0
        for text in map(_text, texts):
            part.append(text)
            held += len(text)
            if len(part) == CHUNK_TEXTS or held >= CHUNK_CHARS:
                yield part
                part, held = [], 0
        if part:
            yield part

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (shard,) = key
        draws = Draws(self.weights, f"{self.seed}-{shard}", 1)
        held = _waiting(rows)
        names = [name for name, _ in draws.ends]
        # By source the first chunk of its queue in the state, the next one's number, and whether it has ended.
        places = {name: [0, 0, False] for name in names}
        for (name,), (first, next_, over) in self.sources.iterator():
            places[name] = [first, next_, bool(over)]
        head, new = {name: deque() for name in names}, {name: deque() for name in names}
        while held:
            _, source, text, last = held.pop()
            if places[source][2]:
                continue
            if last:
                places[source][2] = True
            elif text is not None:
                new[source].append(text)

        def take(name: str) -> str | None:
            place = places[name]
            if not head[name] and place[0] < place[1]:
                at = (name, place[0])
                head[name].extend(self.queues.getValue(at)[0])
                self.queues.removeKey(at)
                place[0] += 1
            if head[name]:
                return head[name].popleft()
            return _text(new[name].popleft()) if new[name] else None

        left = lambda name: bool(head[name] or new[name] or places[name][0] < places[name][1])
        words, blocks, number = self.words.get() if self.words.exists() else ([], 0, 0)
        words, out = list(words), []
        texts = [t for (t,) in self.texts.get()] if self.texts.exists() else []

        def pack(ready: list[str]) -> None:
            nonlocal words
            for tokens in self.tokenise(ready):
                words.extend(tokens)
            full = len(words) // self.size * self.size
            out.extend(words[i : i + self.size] for i in range(0, full, self.size))
            words = words[full:]

        def given() -> pd.DataFrame:
            nonlocal blocks
            if self.samples is not None:
                del out[max(0, self.samples - blocks) :]
            got = pd.DataFrame([(shard, blocks + i, tokens) for i, tokens in enumerate(out)], columns=["shard", "block_no", "tokens"])
            blocks += len(out)
            out.clear()
            return got

        all_ended = all(over for _, _, over in places.values())
        while not all_ended or any(map(left, names)):
            name = draws.source(number)
            text = take(name)
            if text is None and not places[name][2]:
                break
            number += 1  # a source that has ended and has no document left isn't drawn
            if text is not None:
                texts.append(text)
            if len(texts) >= self.together:
                pack(texts)
                texts = []
                if len(out) * self.size >= TOGETHER:
                    yield given()
        else:
            pack(texts)
            texts = []
            if self.with_rest and words:
                out.append(words)
                words = []
        for name in names:
            first, next_, over = places[name]
            if head[name]:
                first -= 1
                self.queues.updateValue((name, first), (list(head[name]),))
            for part in self._chunks(new[name]):
                self.queues.updateValue((name, next_), (part,))
                next_ += 1
            self.sources.updateValue((name,), (first, next_, over))
        if texts:
            self.texts.put([(t,) for t in texts])
        else:
            self.texts.clear()
        if out:
            yield given()
        self.words.update((words, blocks, number))

    def close(self) -> None:
        pass


def packed_shared(
    docs: DataFrame,
    weights: dict[str, float],
    size: int,
    seed: int | str,
    shards: int = 1,
    samples: int | None = None,
    together: int = 512,
    tokenise: Callable[[list[str]], list[list[str]]] = split_words,
    rest: bool = True,
) -> DataFrame:
    """shard, block_no and tokens of blocks of size tokens through one buffer for all sources: documents are drawn by weight, one after the other, and packed without regard to their source.

    docs as in packed_mixture(). Each shard draws for itself, as a worker with a seed of its own. What comes out doesn't hang on how the documents are divided into triggers, so long as a shard's documents of a source come in order of pos:
    one waits in the state until every source's documents of earlier draws are there or the source has ended. A source that has ended isn't drawn any more. samples bounds the blocks of each shard.
    """
    names = [name for name, _ in normalized(weights)]
    shard = F.pmod(F.col("pos"), F.lit(shards)).cast("int")
    if "shard" in docs.columns:
        shard = F.coalesce(F.col("shard"), shard).cast("int")
    rows = docs.where(F.col("source").isin(names)).select(shard.alias("shard"), "source", "pos", "text", F.coalesce("ended", F.lit(False)).alias("ended"))
    processor = SharedPacking(weights, size, seed, samples, together, tokenise, rest)
    return rows.groupBy("shard").transformWithStateInPandas(processor, "shard int, block_no long, tokens array<string>", "append", "None")


def ends(spark: SparkSession, sources: list[str], shards: int) -> DataFrame:
    """A row with ended for each shard of each source, to come after its last document: source, shard, pos, text and ended."""
    rows = [(s, k, None, None, True) for s in sources for k in range(shards)]
    return spark.createDataFrame(rows, "source string, shard int, pos long, text string, ended boolean")


def run(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Takes all that there is through the stream into the Parquet table at path, and gives the table. A stream that is stopped goes on where it was."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k) for k in _CONF}
    for k, v in _CONF.items():
        conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def filled(blocks: DataFrame, weights: dict[str, float], samples: int, seed: int | str, size: int) -> DataFrame:
    """All draws below samples: each source's full blocks in order, and from the first again when the source has run out. blocks is what packed_mixture() gave of a bounded input.

    Gives block_no, source, source_block and tokens; a source without a full block gives none.
    """
    full = numbered(blocks.where(F.size("tokens") == size), "source_block", "_place", by="source")
    sizes = full.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    draws = blocks.sparkSession.range(samples).select(F.col("id").alias("block_no")).withColumn("source", drawn(uniform("block_no", seed), weights))
    placed = numbered(draws, "block_no", "_k", by="source").join(F.broadcast(sizes), "source").withColumn("_place", F.col("_k") % F.col("_n"))  # a row for each source
    return placed.select("block_no", "source", "_place").join(full.drop("block_no"), ["source", "_place"]).select("block_no", "source", "source_block", "tokens")
