"""Every reader and writer over a fixture that is written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, factorial, generate, scoring, tokenizers
from ..operators.order import numbered
from ..sources import events, readers, writers
from ..sources.files import opened
from ..sources.tables import new_folder, stored
from ..streaming import packing
from . import generation as gen
from .base import number, table
from .catalog import query


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def csv_all_strings(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "csv")
    writers.csv(table(spark, d, "labels"), path, ["doc_id", "quality", "toxic"])
    return readers.csv_strings(spark, path, line_ends=False)


@query("SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS folder, n_name, true AS named FROM nation")
def csv_with_file_name(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "glob")
    for k, name in enumerate(("even", "odd")):
        writers.csv(table(spark, d, "nation").where(f"n_regionkey % 2 = {k}"), f"{path}/{name}", ["n_name"])
    rows = readers.with_file_name(spark, f"{path}/*/*.csv", lambda s, p: readers.csv_strings(s, p, line_ends=False))
    return rows.select("folder", "n_name", F.col("file_name").endswith(".csv").alias("named"))


_CLOZE = """c AS (SELECT user_id, event_type AS cand, count(*) % 2 AS target, max(value) AS logp FROM events GROUP BY user_id, event_type),
b AS (SELECT user_id, 'c' || (user_id % 3) AS category, cand, target, row_number() OVER (PARTITION BY user_id ORDER BY logp DESC, cand) AS r FROM c)"""


def _cloze(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Examples read from nested JSON documents, fifty users in each, and scores of their candidates."""
    path = new_folder(spark, "cloze")
    rows = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("cand")).agg((F.count(F.lit(1)) % 2).cast("double").alias("target"), F.max("value").alias("logp"))
    rows = stored(rows, "cloze-rows")
    each = rows.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cand", "target")))).alias("target_scores"))
    example = F.struct(F.col("user_id").cast("string").alias("input"), "target_scores", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("comment"))
    docs = each.groupBy(F.floor(F.col("user_id") / 50).alias("doc")).agg(F.collect_list(example).alias("examples")).repartition("doc")  # fifty examples
    docs.write.partitionBy("doc").json(path)
    examples = readers.cloze_examples(spark, f"{path}/*/*.json").select(F.col("input").alias("item"), F.col("comment").alias("category"), "target_scores")
    return examples, rows.select(F.col("user_id").cast("string").alias("item"), "cand", "logp")


@query(f"WITH {_CLOZE} SELECT coalesce(category, 'ALL') AS category, count(*) AS n, sum(target)::BIGINT AS n_correct, round(avg(target), 6) AS accuracy FROM b WHERE r = 1 GROUP BY ROLLUP(category)")
def cloze_json(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by category of the examples of nested JSON documents."""
    got = evaluate.cloze_accuracy(*_cloze(spark, d))
    return got.withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_CLOZE}, l AS (SELECT user_id, bool_or(cand = 'error') AS lost FROM c GROUP BY user_id) SELECT lost, count(*) AS n, coalesce(sum(target) FILTER (WHERE NOT lost), 0)::BIGINT AS n_correct FROM l JOIN b USING (user_id) WHERE r = 1 GROUP BY lost")
def cloze_lost(spark: SparkSession, d: str) -> DataFrame:
    """Examples with a candidate that has no score are skipped and counted."""
    examples, scores = _cloze(spark, d)
    best = evaluate.cloze_best(examples, scores.where("cand <> 'error'"))
    right = F.coalesce(F.sum(F.when(F.col("lost") == 0, F.col("ok"))), F.lit(0))
    return best.groupBy((F.col("lost") > 0).alias("lost")).agg(F.count(F.lit(1)).alias("n"), right.alias("n_correct"))


@query(
    """WITH c AS (SELECT *, conv_id // 20 AS part FROM conversations), f AS (SELECT role, part, min_by('u' || conv_id, conv_id * 1000000 + turn) AS uid FROM c GROUP BY role, part)
SELECT uid AS "UID", 'f-' || role AS field, role AS linguistics_term, conv_id || '-' || turn AS "pairID", length(text) AS n_good FROM c JOIN f USING (role, part)"""
)
def paradigms_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of JSON lines files with the attributes of each file's first record."""
    path = new_folder(spark, "paradigms")
    rows = table(spark, d, "conversations").select(
        F.concat_ws("-", "role", F.floor(F.col("conv_id") / 20)).alias("folder"), "conv_id", "turn", F.concat(F.lit("u"), "conv_id").alias("UID"), F.concat(F.lit("f-"), "role").alias("field"), F.col("role").alias("linguistics_term"),
        F.concat_ws("-", "conv_id", "turn").alias("pairID"), F.col("text").alias("sentence_good"), F.lit("x").alias("sentence_bad"),
    )
    rows.repartition("folder").sortWithinPartitions("folder", "conv_id", "turn").drop("conv_id", "turn").write.partitionBy("folder").json(path)  # one file for each paradigm is the format
    return readers.paradigms(spark, f"{path}/*/*.json").select("UID", "field", "linguistics_term", "pairID", F.length("sentence_good").cast("long").alias("n_good"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "array")
    whole = table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("text"))  # 25 nations at every size
    writers.text(whole, path)
    return readers.json_array(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT")


@query("SELECT 'run=' || event_type AS run, round(avg(value), 6) AS train_loss, round(max(value), 6) AS val_loss FROM events GROUP BY event_type")
def run_metric_files(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "runs")
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("train_loss"), F.max("value").alias("val_loss"))
    rows.repartition("run").write.partitionBy("run").json(path)
    return readers.run_metrics(spark, f"{path}/*/*.json").select("run", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"))


def _yaml_folder(spark: SparkSession, d: str) -> str:
    """A YAML file for each nation, one of them broken."""
    path = new_folder(spark, "yaml")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("out_dir"), F.col("n_nationkey").alias("key"))
    text = writers.yaml_text(rows, ["out_dir", "key"]).select("key", F.when(F.col("key") == 3, "out_dir: [1\n").otherwise(F.col("yaml")).alias("text"))
    text.repartition("key").write.partitionBy("key").text(path)
    return path


@query("SELECT CASE WHEN n_nationkey <> 3 THEN n_name END AS out_dir, CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS key FROM nation")
def yaml_files(spark: SparkSession, d: str) -> DataFrame:
    """Parsed configurations; one that can't be parsed is empty."""
    return readers.yaml_documents(spark, f"{_yaml_folder(spark, d)}/*/*.txt", "out_dir STRING, key INT").select("config.*")


@query(
    "SELECT r_name AS out_dir, list_sort(list(n_name)) AS files, count(*) AS n, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey / 4 END AS weight, min(n_nationkey) AS first FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey"
)
def nested_yaml_files(spark: SparkSession, d: str) -> DataFrame:
    """Configurations with lists, maps and settings inside of settings, written and read back."""
    path = new_folder(spark, "yaml")
    nations = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"), F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("first"))
    rows = table(spark, d, "region").join(nations, "r_regionkey")
    weight = F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") / 4)
    rows = rows.select(
        F.col("r_regionkey").alias("key"), F.col("r_name").alias("out_dir"), F.struct(F.col("names").alias("files"), F.create_map(F.lit("n"), F.col("n")).alias("counts"), F.struct(weight.alias("weight")).alias("mixture")).alias("data"), "first"
    )
    writers.yaml_text(rows, ["out_dir", "data", "first"]).select("key", F.col("yaml").alias("text")).repartition("key").write.partitionBy("key").text(path)
    got = readers.yaml_documents(spark, f"{path}/*/*.txt", "out_dir STRING, first BIGINT, data STRUCT<files: ARRAY<STRING>, counts: MAP<STRING, BIGINT>, mixture: STRUCT<weight: DOUBLE>>").select("config.*")
    return got.select("out_dir", F.col("data.files").alias("files"), F.col("data.counts")["n"].alias("n"), F.col("data.mixture.weight").alias("weight"), "first")


@query("SELECT CASE WHEN n_nationkey = 3 THEN '[1' ELSE n_name END AS out_dir FROM nation")
def yaml_key_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return readers.yaml_key(spark, f"{_yaml_folder(spark, d)}/*/*.txt", "out_dir").select("out_dir")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS line, n_name AS config, 'out/' || n_nationkey AS out_dir FROM nation")
def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "manifest")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("exp"), F.col("n_name").alias("config"), F.concat(F.lit("out/"), F.col("n_nationkey").cast("string")).alias("out_dir"))
    writers.manifest(rows, path)
    return readers.manifest(spark, path)


@query("SELECT 'run-' || event_type AS run, 'tag' || (user_id % 3) AS tag, user_id % 40 AS step, round(CAST(count(*) AS DOUBLE), 6) AS value FROM events GROUP BY ALL")
def event_files(spark: SparkSession, d: str) -> DataFrame:
    """Scalars written to event files by tasks, a folder for each type of event, and read back with their checksums."""
    path = new_folder(spark, "events")
    tag, step = F.concat(F.lit("tag"), (F.col("user_id") % 3).cast("string")), F.col("user_id") % 40
    rows = table(spark, d, "events").groupBy(F.concat(F.lit("run-"), "event_type").alias("run"), tag.alias("tag"), step.alias("step")).agg(F.count(F.lit(1)).alias("value"))
    events.write(rows.withColumn("time", F.lit(0.0)), path)
    got = events.read(spark, f"{path}/*/events*")
    return got.where("damaged_bytes is null").select("run", "tag", "step", F.round("value", 6).alias("value"))


@query(
    """WITH e AS (SELECT event_type AS run, user_id AS step, CAST(max(event_id) AS DOUBLE) AS value FROM events GROUP BY event_type, user_id),
r AS (SELECT run, count(*) AS n, max(step) AS last FROM e GROUP BY run) SELECT run, n - 1 AS n_scalars, n - 1 AS n_steps, 1 AS n_damaged_files, (SELECT max(step) FROM e WHERE e.run = r.run AND step < r.last) AS last_step FROM r"""
)
def damaged_event_files(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each file is damaged: it doesn't count, the file is reported, all before it is there."""
    path, broken = new_folder(spark, "events"), new_folder(spark, "broken")
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("step")).agg(F.max("event_id").alias("value"))
    events.write(rows.select("run", F.lit("loss").alias("tag"), "step", F.lit(1.5).alias("time"), "value"), path)

    def damage(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                run, name = path.rsplit("/", 2)[-2:]
                system, inside = opened(f"{broken}/{run}/{name}")
                system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                content = bytearray(content)
                content[-6] ^= 1
                with system.open_output_stream(inside) as out:
                    out.write(bytes(content))
                yield f[["path"]].head(1)

    spark.read.format("binaryFile").load(f"{path}/*/events*").mapInPandas(damage, "path string").count()
    got = events.read(spark, f"{broken}/*/events*").groupBy("run").agg(F.count("value").alias("n_scalars"), F.count_distinct("step").alias("n_steps"), F.count("damaged_bytes").alias("n_damaged_files"), F.max("step").alias("last_step"))
    return got


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'validation' END AS split, count(*) AS n, sum(length(source))::BIGINT AS n_chars FROM documents GROUP BY 1")
def named_splits(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "splits")
    for k, name in enumerate(("test", "train", "validation")):
        writers.text(table(spark, d, "documents").where(f"doc_id % 3 = {k}"), f"{path}/{name}", "source")
    rows = readers.split_files(spark, {n: f"{path}/{n}" for n in ("train", "validation", "test")})
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


_CKPT = "c AS (SELECT 'runs/r' || (doc_id % 7) || CASE WHEN doc_id % 5 = 4 THEN '/final' ELSE '/checkpoint-' || (doc_id * 37 % 10007) END AS path FROM documents)"


def _ckpts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    last = F.when(k % 5 == 4, "/final").otherwise(F.concat(F.lit("/checkpoint-"), (k * 37 % 10007).cast("string")))
    return table(spark, d, "documents").select(F.concat(F.lit("runs/r"), (k % 7).cast("string"), last).alias("path"))


@query(f"WITH {_CKPT}, s AS (SELECT path, CAST(regexp_extract(path, '(\\d+)$', 1) AS BIGINT) AS step FROM c WHERE path NOT LIKE '%final') SELECT path, step, row_number() OVER (ORDER BY step, path) - 1 AS place FROM s")
def checkpoint_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints in order of the number at the end of their names, not of the names."""
    return numbered(readers.checkpoints(spark, _ckpts(spark, d)), "step", "place", ("path",))


@query(f"WITH {_CKPT}, s AS (SELECT path, regexp_extract(path, 'r(\\d)', 1) AS run, CAST(regexp_extract(path, '(\\d+)$', 1) AS BIGINT) AS step FROM c WHERE path NOT LIKE '%final') SELECT run, arg_max(path, step) AS path, max(step) AS step FROM s GROUP BY run")
def latest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.checkpoints(spark, _ckpts(spark, d)).withColumn("run", F.regexp_extract("path", r"r(\d)", 1))
    return evaluate.latest(rows, ["run"])


@query("SELECT doc_id, doc_id % 9 AS epoch, CASE WHEN doc_id % 4 = 0 THEN 10000 ELSE doc_id % 300 END AS batch FROM documents")
def epochs_and_batches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(F.lit("m_epoch_"), (k % 9).cast("string"), F.when(k % 4 == 0, ".pt").otherwise(F.concat(F.lit("_batch_"), (k % 300).cast("string"))))
    epoch, batch = readers.epoch_and_batch(name)
    return table(spark, d, "documents").select(k, epoch.alias("epoch"), batch.cast("long").alias("batch"))


@query("SELECT DISTINCT 'm/' || (doc_id % 50) AS folder FROM documents WHERE doc_id % 3 = 0")
def marked_folders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    files = table(spark, d, "documents").select(F.concat(F.lit("m/"), (k % 50).cast("string"), F.when(k % 3 == 0, "/config.json").otherwise("/weights.bin")).alias("path"))
    return readers.model_folders(files, ["config.json", "lit_model.pth"])


@query(r"SELECT item_id, sha1(text) AS key, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS n_tokens, item_id % 2 = 0 AS from_cache FROM benchmark")
def cached_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens from a cache by hash of the text, worked out where it lacks the text."""
    texts = table(spark, d, "benchmark").select("item_id", "text")
    marked = F.concat(F.array(F.lit("known")), T.words("text"))
    cache = new_folder(spark, "cache")
    texts.where("item_id % 2 = 0").select(F.sha1("text").alias("key"), marked.alias("tokens")).dropDuplicates(["key"]).write.parquet(cache)
    got = readers.token_cache(texts, spark.read.parquet(cache), T.words("text"))
    known = F.coalesce(F.try_element_at("tokens", F.lit(1)) == "known", F.lit(False))
    return got.select("item_id", "key", (F.size("tokens") - known.cast("int")).cast("long").alias("n_tokens"), known.alias("from_cache"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS at, source AS left_line, lang AS right_line FROM documents")
def parallel_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files whose lines belong together, written apart and joined by the place of the line."""
    path = new_folder(spark, "parallel")
    writers.parallel_text(table(spark, d, "documents"), {"source": f"{path}/a", "lang": f"{path}/b"}, "doc_id")
    a, b = (numbered(readers.text_lines(spark, f"{path}/{x}"), "source", "at", ("pos",)).select("at", F.col("text").alias(n)) for x, n in (("a", "left_line"), ("b", "right_line")))
    return a.join(b, "at")


@query("SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids, true AS bounded FROM documents")
def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a bounded number of blocks of bytes."""
    path = new_folder(spark, "chunks")
    writers.chunks(table(spark, d, "documents").select("doc_id"), path, row_bytes=1024, size=64 << 10)
    files = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    return files.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), (F.max("n") <= 64).alias("bounded"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 4) AS total FROM embeddings")
def array_table(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "arrays")
    writers.arrays(table(spark, d, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, 0::BIGINT AS n_again FROM events")
def resumed_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that is run to its end twice with one checkpoint writes each row once."""
    out, checkpoint = new_folder(spark, "resumed"), new_folder(spark, "checkpoint")
    schema = table(spark, d, "events").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("event_id", "user_id")
    first = packing.run_to_end(stream(), out, checkpoint).count()
    again = packing.run_to_end(stream(), out, checkpoint)
    return again.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), (F.count(F.lit(1)) - F.lit(first)).alias("n_again"))


@query("SELECT doc_id, -CAST(length(source) AS DOUBLE) AS logp FROM documents")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model that takes batches of rows."""
    return scoring.model_score(table(spark, d, "documents").select("doc_id", "source"), lambda f: -f["source"].str.len()).select("doc_id", "logp")


_BW = r"w AS (SELECT DISTINCT lower(unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS word FROM benchmark)"
_LONG = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.IRREGULAR_LONG.items())


@query(
    f"WITH {_BW} SELECT word, {_LONG} ELSE CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN regexp_replace(word, 'y$', '') || 'ies' WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END END AS plural, "
    "replace(replace(replace(word, 'ing', 'ed'), 'the', 'a'), '-', '') AS replaced, regexp_replace('The ' || word, '(?i)^(the|an|a) ', '') AS bare FROM w"
)
def word_forms(spark: SparkSession, d: str) -> DataFrame:
    """Plurals with irregular forms, replacements in order, phrases without their article."""
    words = table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("w")).select(T.lower("w").alias("word")).distinct()
    return words.select("word", T.pluralize_long("word").alias("plural"), T.replace_in_order("word", [("ing", "ed"), ("the", "a")]).alias("replaced"), T.strip_article(F.concat(F.lit("The "), "word")).alias("bare"))


@query("SELECT true AS iso, 20 AS n")
def utc_stamp(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(T.utc_now().alias("t")).select(F.col("t").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("iso"), F.length("t").alias("n"))


_EMPTY = "CASE WHEN quadruplet_id % 3 = 0 THEN '' ELSE post_gap_text END"


@query(
    f"WITH quads AS ({gen._clause_quads('iv')}), e AS (SELECT *, {_EMPTY} AS post FROM quads), f AS (SELECT CASE WHEN filler = 1 AND gap = 1 THEN 'wh_gap' WHEN filler = 1 THEN 'wh_no_gap' WHEN gap = 1 THEN 'no_wh_gap' ELSE 'no_wh_no_gap' END AS cell, "
    "CASE WHEN post = '' THEN trim(substr(sentence, length(pre_gap_text) + 1)) ELSE post END AS filled FROM e) SELECT cell, filled, count(*) AS n FROM f GROUP BY cell, filled"
)
def filled_post_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Condition labels, and what follows the gap from the sentence where it is empty."""
    quads = generate.factorial_clauses(spark, "iv").withColumn("post", F.when(F.col("quadruplet_id") % 3 == 0, "").otherwise(F.col("post_gap_text")))
    rows = quads.select(factorial.cell_name().alias("cell"), factorial.post_gap(F.col("post"), F.col("sentence"), F.col("pre_gap_text")).alias("filled"))
    return rows.groupBy("cell", "filled").agg(F.count(F.lit(1)).alias("n"))


_LISTED = ["the", "and", "of", "a", "la", "de", "die"]


@query(
    r"""WITH w AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '^[.,?!;:"''()\[\]{}]+|[.,?!;:"''()\[\]{}]+$', '', 'g'))) AS ws FROM conversations)
SELECT conv_id, turn FROM w WHERE len(list_filter(ws, lambda x: list_contains("""
    + str(_LISTED)
    + ", x))) = len(list_distinct(list_filter(ws, lambda x: list_contains("
    + str(_LISTED)
    + ", x))))"
)
def without_repeated_words(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which none of the listed words stands twice."""
    return generate.without_repeats(table(spark, d, "conversations").select("conv_id", "turn", "text"), _LISTED, "text").select("conv_id", "turn")


@query(
    r"""WITH p AS (SELECT item_id, unnest(regexp_extract_all(text, '\S+|\s+')) AS part, generate_subscripts(regexp_extract_all(text, '\S+|\s+'), 1) AS i FROM benchmark),
s AS (SELECT item_id, part, i, CAST(coalesce(sum(length(part)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS token_no, part AS token, start, start + length(part) AS "end" FROM s WHERE regexp_matches(part, '\S')"""
)
def tokens_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Any tokenizer of the interface gives tokens with their places in the text."""
    return number(tokenizers.tokens(table(spark, d, "benchmark"), "item_id"), "token_no", "start", "end")
