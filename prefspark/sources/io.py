"""Readers and writers.

Every reader takes an explicit schema: no inference pass over the data.
Writers produce part files (JSON Lines or Parquet), never one document.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prefspark.session import materialize

MSG = "array<struct<role:string,content:string>>"
PREF_SCHEMA = f"id bigint, prompt string, chosen {MSG}, rejected {MSG}"
SCORED_SCHEMA = ("id bigint, instruction string, input string, chosen string, "
                 "rejected string, score_datainf double")
PAIR_SCHEMA = "rank bigint, instruction string, input string, chosen string, rejected string"
PROMPT_SCHEMA = "idx bigint, instruction string, output string"
MATH_ROW_SCHEMA = ("idx bigint, question string, gold string, prediction string, "
                   "correct boolean, generated_text string")
MATH_FILE_SCHEMA = (f"accuracy double, correct bigint, total bigint, "
                    f"results array<struct<question:string,gold:string,prediction:string,"
                    f"correct:boolean,generated_text:string>>, "
                    f"config map<string,string>")


def _reader(spark: SparkSession, schema: str, fmt: str):
    return spark.read.schema(schema).format(fmt)


def read_json_rows(spark: SparkSession, path, schema: str, on_invalid: str = "raise", quarantine: str | None = None) -> DataFrame:
    """JSON Lines with ``schema``; a line that is no object of that shape never becomes a row.

    raise: running the query fails, naming the file and the line.
    quarantine: such lines are appended, as (file, record) rows in Parquet, to
    the folder ``quarantine`` (``read_quarantine``), and the others are read.
    Blank lines are skipped; a key that is absent reads as null.
    """
    if on_invalid not in ("raise", "quarantine") or (on_invalid == "quarantine") != (quarantine is not None):
        raise ValueError("on_invalid must be 'raise', or 'quarantine' with the folder ``quarantine``")
    parsed = F.from_json("value", f"{schema}, _invalid string", {"columnNameOfCorruptRecord": "_invalid", "mode": "PERMISSIVE"})
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("r", parsed)
    names = [c for c in lines.select("r.*").columns if c != "_invalid"]
    bad = F.col("r").isNull() | F.col("r._invalid").isNotNull()
    file = F.col("_metadata.file_path")
    if on_invalid == "raise":
        fail = F.raise_error(F.concat(F.lit("invalid JSON record in "), file, F.lit(": "), F.substring("value", 1, 200)))
        good = lines.where(F.when(bad, fail.cast("boolean")).otherwise(F.lit(True)))  # a filter is never pruned
    else:
        lines.where(bad).select(file.alias("file"), F.col("value").alias("record")).write.mode("append").parquet(quarantine)
        good = lines.where(~bad)
    return good.select(*[F.col(f"r.`{c}`").alias(c) for c in names])


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(file, records): invalid lines per file that ``read_json_rows`` has put aside."""
    return spark.read.schema("file string, record string").parquet(path).groupBy("file").agg(F.count("*").alias("records"))


def with_position_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Dense positions 0..n-1, in file order, for rows read from id-less files.

    ``df`` is a frame read from files. Files are taken by path, their blocks by
    offset; a block's rows are contiguous in one task, so a row's position is
    the number of rows in earlier blocks (one count per block, a bounded table)
    plus its place in the block. The rows are written once, so that counting
    and numbering see the same ones.
    """
    rows = materialize(df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at")), "positions")
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    position = F.col("_before") + F.col("_at") - F.col("_first")
    out = rows.join(blocks, ["_file", "_block"]).withColumn(id_col, position.cast("long"))
    return out.select(*[c for c in df.columns if c != id_col], id_col).select(
        *(df.columns if id_col in df.columns else [id_col, *df.columns]))


PREF_LONG_SCHEMA = "id bigint, side string, turn bigint, role string, text string"


def read_preferences(spark: SparkSession, path: str, fmt: str = "parquet", layout: str = "nested",
                     assign_ids: bool = False, on_invalid: str = "raise", quarantine: str | None = None) -> DataFrame:
    """Preference records.

    nested: (id, prompt, chosen, rejected) with message arrays; long: one
    row per message (id, side, turn, role, text). Invalid lines of JSON files
    are handled as by ``read_json_rows``.
    """
    schema = {"nested": PREF_SCHEMA, "long": PREF_LONG_SCHEMA}[layout]
    df = read_json_rows(spark, path, schema, on_invalid, quarantine) if fmt == "json" else _reader(spark, schema, fmt).load(path)
    return with_position_ids(df) if (assign_ids and layout == "nested") else df


HEAP_ROWS = 100_000  # up to so many rows, a heap of them per task is gathered in one task


def limit_first(df: DataFrame, n: int | None, order: str | list[str] = "id", heap_rows: int = HEAP_ROWS) -> DataFrame:
    """The first min(n, len) rows by ``order`` (nulls first); None and 0 mean all rows.

    Up to ``heap_rows`` orderBy + limit plans TakeOrderedAndProject: a heap of
    n per task, gathered in one. Beyond, rows are dealt into sorted ranges,
    written once; the ranges' counts tell which are taken whole, and the one
    that the limit falls into is cut by place: no task holds more than a range.
    Of rows that tie at the limit any may be taken, so order by a unique key.
    """
    if not n:
        return df
    order = order if isinstance(order, list) else [order]
    if n <= heap_rows:
        return df.orderBy(order).limit(int(n))
    keys = [F.asc_nulls_first(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialize(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", "_first", before.alias("_before")).where(F.col("_before") < n)
    taken = dealt.join(F.broadcast(ranges), "_range").where(F.col("_before") + F.col("_at") - F.col("_first") < n)
    return taken.select(*[F.col(f"`{c}`") for c in df.columns])


def normalize_scores(df: DataFrame, score_col: str = "score_datainf") -> DataFrame:
    """S3 body: every null string becomes "", a NaN score becomes null (sorted last)."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    out = df.na.fill("", strings)
    s = F.col(score_col)
    return out.withColumn(score_col, F.when(F.isnan(s), F.lit(None).cast("double")).otherwise(s))


def read_scores(spark: SparkSession, path: str, assign_ids: bool = False, on_invalid: str = "raise",
                quarantine: str | None = None) -> DataFrame:
    """S3: JSON Lines score rows with the S3 normalisation.

    ``assign_ids`` gives files without an ``id`` field positional ids. A
    broken line never becomes a scored row: see ``read_json_rows``.
    """
    df = read_json_rows(spark, path, SCORED_SCHEMA, on_invalid, quarantine)
    if assign_ids:
        df = with_position_ids(df)
    return normalize_scores(df)


def write_scores(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines part files, UTF-8 with non-ASCII unescaped; every record has every key, null where it has no value."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_pairs(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Pair records as JSON Lines (or Parquet) part files; every record has every key."""
    df.write.mode(mode).format(fmt).option("ignoreNullFields", False).save(path)


def read_pairs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _reader(spark, PAIR_SCHEMA, fmt).load(path)


def _first_existing(spark: SparkSession, reader, candidates: list[str]) -> DataFrame:
    err = None
    for c in candidates:
        try:
            return reader(c)
        except AnalysisException as e:  # path or glob matched nothing
            err = e
    raise FileNotFoundError(f"no result file under {candidates[0]}") from err


def _plain_path(uri: str) -> str:
    """The path of a file's URI, whatever number of slashes follow its scheme."""
    return unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", uri))


SUBJECT_LONG_SCHEMA = "task string, acc double, label string"


def read_subject_results(spark: SparkSession, path: str, file_name: str = "mmlu_results.json",
                         layout: str = "documents") -> DataFrame:
    """Subject results as (label, task, acc).

    documents: ``path`` is a result file, a folder holding ``file_name``, or a
    parent whose children each hold one (one level down); the label is the
    parent folder's name, as it is spelt on disk, and a task without
    ``acc,none`` gives a null acc. Every document gives a row: one without
    results has a null task and acc, so its label is not lost. Raises when
    there is no such file, and, when run, for a file that is no such document,
    naming its path (an empty file at once).
    long: what ``write_subject_results`` produces (``label=<x>/`` folders of
    (task, acc) rows).
    """
    base = path.rstrip("/")
    if layout == "long":
        return spark.read.schema(SUBJECT_LONG_SCHEMA).json(base).select("label", "task", "acc")
    if layout != "documents":
        raise ValueError("layout must be 'documents' or 'long'")

    def reader(p):
        return spark.read.text(p, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), "value")

    cands = [base] if base.endswith(".json") else [f"{base}/{file_name}", f"{base}/*/{file_name}"]
    files = _first_existing(spark, reader, cands)
    # Spark skips files without a byte; the listing, one name per evaluated model, is on the driver anyway
    empty = {_plain_path(f) for f in files.inputFiles()} - {_plain_path(r["_f"]) for r in files.select("_f").collect()}
    if empty:
        raise ValueError(f"not a subject result document: {min(empty)}")
    # values stay JSON text here: what a task holds besides its accuracy has any shape
    parsed = F.from_json("value", "results map<string,string>, _invalid string", {"columnNameOfCorruptRecord": "_invalid"})
    path_of = F.url_decode(F.replace("_f", F.lit("+"), F.lit("%2B")))  # file paths are URIs: only %xx stands for something else
    docs = files.withColumn("r", parsed).withColumn("_p", path_of)
    bad = F.col("r").isNull() | F.col("r._invalid").isNotNull()
    fail = F.raise_error(F.concat(F.lit("not a subject result document: "), F.col("_p"))).cast("boolean")
    docs = docs.where(F.when(bad, fail).otherwise(F.lit(True)))  # a filter is never pruned
    rows = docs.select(F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1).alias("label"), F.explode_outer("r.results").alias("task", "v"))
    acc = F.get_json_object("v", "$['acc,none']")
    return rows.select("label", "task", acc.try_cast("double").alias("acc"))


def write_subject_results(acc: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(label, task, acc) rows as JSON Lines under ``label=<x>/`` folders (readable by S7).

    One row per (label, task): nothing is gathered per label, however many
    tasks a label has.
    """
    acc.select("label", "task", "acc").write.mode(mode).partitionBy("label").json(path)


def read_math_results(spark: SparkSession, path: str) -> DataFrame:
    """Per-question math results.

    Reads the part files written by ``write_metrics`` (``<path>/results``),
    or a single result document ``{accuracy, correct, total, results[]}``.
    Part files of a run that broke off raise.
    """
    base = path.rstrip("/")
    if not base.endswith(".json") and _exists(spark, f"{base}/started") and not is_complete(spark, base):
        raise ValueError(f"{base}: the run that wrote it has not ended")
    if base.endswith(".json"):
        doc = spark.read.schema(MATH_FILE_SCHEMA).option("multiLine", True).json(base)
        return doc.select(F.posexplode("results").alias("idx", "r")).select(F.col("idx").cast("long").alias("idx"), "r.*")
    return spark.read.schema(MATH_ROW_SCHEMA).parquet(f"{base}/results")


def read_math_document(spark: SparkSession, path: str) -> DataFrame:
    """What a result document says about its run: (accuracy, correct, total, config)."""
    doc = spark.read.schema(MATH_FILE_SCHEMA).option("multiLine", True).json(path)
    return doc.select("accuracy", "correct", "total", "config")


def read_prompts(spark: SparkSession, path_or_df, fmt: str = "json", assign_ids: bool = False,
                 on_invalid: str = "raise", quarantine: str | None = None) -> DataFrame:
    """Prompts with their reference output; a missing output reads as "".

    ``assign_ids`` gives files without an ``idx`` field positional ids.
    Invalid lines of JSON files are handled as by ``read_json_rows``.
    """
    if isinstance(path_or_df, DataFrame):
        df = path_or_df
    elif fmt == "json":
        df = read_json_rows(spark, path_or_df, PROMPT_SCHEMA, on_invalid, quarantine)
    else:
        df = _reader(spark, PROMPT_SCHEMA, fmt).load(path_or_df)
    if assign_ids:
        df = with_position_ids(df, "idx")
    return df.select("idx", "instruction", F.coalesce(F.col("output"), F.lit("")).alias("output"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.schema("rows long").parquet(path).limit(1).count() > 0
    except AnalysisException:
        return False


def write_metrics(metrics, results: DataFrame, path: str,
                  mode: str = "errorifexists") -> None:
    """Metrics (a one-row table) and per-row results, side by side as Parquet.

    ``metrics`` is a DataFrame, or a function of the results: then the rows
    are written first and the metrics are computed from the written table,
    so the per-row work runs once.

    ``started`` is written first and ``complete`` (the number of result rows)
    last. A folder that a run has started and not completed is written anew
    whatever the ``mode``, so a run that broke off is simply run again.
    """
    base, spark = path.rstrip("/"), results.sparkSession
    broken_off = _exists(spark, f"{base}/started") and not _exists(spark, f"{base}/complete")
    how = "overwrite" if broken_off or mode == "overwrite" else mode
    marker = spark.createDataFrame([(0,)], "rows long").coalesce(1)
    if how == "overwrite":  # from here on the folder counts as not complete
        marker.limit(0).write.mode("overwrite").parquet(f"{base}/complete")
    marker.write.mode(how).parquet(f"{base}/started")
    results.write.mode(how).parquet(f"{base}/results")
    written = spark.read.parquet(f"{base}/results")
    (metrics(written) if callable(metrics) else metrics).write.mode(how).parquet(f"{base}/metrics")
    written.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{base}/complete")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether ``write_metrics`` has written all of its parts under ``path``."""
    return _exists(spark, f"{path.rstrip('/')}/complete")


REGISTRY_SCHEMA = "key string, file_name string, ranking boolean, columns map<string,string>"
# The column mapping every registered preference dataset uses.
DPO_COLUMNS = {"prompt": "instruction", "query": "input", "chosen": "chosen", "rejected": "rejected"}


def read_registry(spark: SparkSession, path: str | None, layout: str = "object", on_invalid: str = "raise") -> DataFrame:
    """S6 input: the dataset registry as rows (key, file_name, ranking, columns); a missing path is empty.

    object: JSON documents, each one object keyed by dataset name, on any
    number of lines. lines: what ``write_registry`` produces, an entry a line.
    Invalid JSON raises; with ``on_invalid="empty"`` a registry that has any
    is read as empty as a whole, so that no part of it is lost unnoticed.
    """
    if layout not in ("object", "lines") or on_invalid not in ("raise", "empty"):
        raise ValueError("layout must be 'object' or 'lines', on_invalid 'raise' or 'empty'")
    empty = spark.createDataFrame([], REGISTRY_SCHEMA)
    if not path:
        return empty
    try:
        text = spark.read.text(path, wholetext=layout == "object").where(F.trim("value") != "")
    except AnalysisException:
        return empty
    # an entry that does not parse is null, so it can be counted
    entry = "struct<file_name:string,ranking:boolean,columns:map<string,string>>"
    schema = f"map<string,{entry}>" if layout == "object" else REGISTRY_SCHEMA
    parsed = text.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("v"))
    bad = F.col("r").isNull() | F.col("v").isNull() | ((F.lit(layout) == "lines") & F.try_variant_get("v", "$.key", "string").isNull())
    if parsed.where(bad).limit(1).count():
        if on_invalid == "raise":
            raise ValueError(f"invalid registry entry under {path}")
        return empty
    if layout == "lines":
        return parsed.select("r.*")
    return parsed.select(F.explode("r").alias("key", "e")).select("key", "e.*")


def write_registry(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Registry rows as JSON Lines (``read_registry`` with ``layout="lines"``)."""
    entries.select("key", "file_name", "ranking", "columns").write.mode(mode).json(path)


def registry_entries(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    """New registry rows: key -> file name, ranking on, the fixed DPO column mapping."""
    rows = [(k, f, True, dict(DPO_COLUMNS)) for k, f in entries.items()]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)
