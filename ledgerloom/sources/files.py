"""File sources and sinks with the contracts of an evidence dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def strict_jsonl(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """JSON lines of a closed schema; blank lines are skipped.

    Raises ``file:line`` of a line that isn't an object of the schema, and for a repeated ``key``. Unknown fields,
    values of another type, repeated keys, NaN and bytes that are no UTF-8 make a line bad.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    given, kept = F.from_json("value", "map<string,string>"), F.from_json(F.to_json("r", {"ignoreNullFields": "false"}), "map<string,string>")
    named = lambda m: F.map_filter(m, lambda _, x: x.isNotNull())
    same = (F.size(F.map_keys(given)) <= F.size(F.map_keys(kept))) & (F.array_sort(F.map_keys(named(given))) == F.array_sort(F.map_keys(named(kept))))
    parsed = parsed.withColumn("ok", F.col("v").isNotNull() & F.is_valid_utf8("value") & F.coalesce(same, F.lit(False)))
    bad = parsed.filter("NOT ok").select("file", "value").head()
    if bad:
        whole = spark.read.text(bad.file, wholetext=True).select(F.array_position(F.split("value", "\n"), bad.value).alias("n")).head()
        raise ValueError(f"{bad.file}:{whole.n}: not an object of the schema")
    rows = parsed.select("r.*")
    if key and not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{path}: repeated {key}")
    return rows


def checked_csv(spark: SparkSession, path: str, required: list[str], exact: bool = False, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """CSV whose values stay strings; the header must hold (``exact``: be) the required columns, values be in their domains."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if (df.columns != required) if exact else set(required) - set(df.columns):
        raise ValueError(f"{path}: columns {df.columns}")
    if domains:  # all of them in one pass
        outside = df.agg(*(F.count_if(~F.coalesce(F.col(c).isin(allowed), F.lit(False))).alias(c) for c, allowed in domains.items())).head()
        if any(outside):
            raise ValueError(f"{path}: outside their domains: {[c for c in domains if outside[c]]}")
    return df


def id_list(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(position, id) of a list file: comments and blanks dropped, order kept; raises for bad or repeated ids."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
    ids = text.select("line", F.trim(F.split_part("raw", F.lit("#"), F.lit(1))).alias("id")).filter("id <> ''")
    if not ids.filter(~F.col("id").rlike(rf"\A(?:{pattern})\z")).isEmpty() or not ids.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError(f"{path}: malformed or repeated id")
    return ids.select(F.col("line").alias("position"), "id")


def file_inventory(spark: SparkSession, path: str, glob: str = "*", hashed: bool = True) -> DataFrame:
    """(path, kind, size, sha256) of all files under ``path``; without ``hashed`` no file's content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind")
    return files.select("path", kind, F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def parquet_footers(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """(path, n_rows, row_groups, columns, codec) from the footers of the Parquet files under ``path``.

    Raises for a file of more than ``most`` bytes or without rows or row groups beyond its declared limits.
    """
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.withColumn("content", F.when(F.col("length") <= most, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path"))))

    def run(it):
        for batch in it:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = pq.ParquetFile(io.BytesIO(content)).metadata
                codec = m.row_group(0).column(0).compression.lower() if m.num_row_groups else None
                out.append((name, m.num_rows, m.num_row_groups, [c for c in m.schema.names], codec))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["path", "n_rows", "row_groups", "columns", "codec"])

    return files.select("path", "content").mapInArrow(run, "path string, n_rows bigint, row_groups bigint, columns array<string>, codec string").filter("n_rows > 0")


def integrity(records: DataFrame) -> DataFrame:
    """Records (allowed, content, content_sha256, others) with ``state`` and ``text``: not_allowed, missing, altered, not_text or ok."""
    ok_hash = F.sha2("content", 256) == F.regexp_replace("content_sha256", "^sha256:", "")
    state = F.when(~F.col("allowed"), "not_allowed").when(F.col("content").isNull(), "missing").when(~F.coalesce(ok_hash, F.lit(False)), "altered").when(~F.is_valid_utf8(F.col("content")), "not_text").otherwise("ok")
    out = records.withColumn("state", state)
    return out.withColumn("text", F.when(F.col("state") == "ok", F.col("content").cast("string"))).drop("content", "content_sha256", "allowed")


def replayed(now: DataFrame, captured: DataFrame, key: list[str], result: str, by: str) -> DataFrame:
    """Per ``by``: requests, those with a recorded result, those where running again gives another, repeated keys recorded."""
    kept = captured.groupBy(*key).agg(F.min(result).alias("_was"), F.count("*").alias("_n"))
    x = now.join(kept, key, "left").groupBy(by)
    return x.agg(F.count("*").alias("requests"), F.count("_n").alias("replayed"), F.count_if(F.col("_n").isNotNull() & ~F.col(result).eqNullSafe(F.col("_was"))).alias("differing"), F.count_if(F.col("_n") > 1).alias("repeated_keys"))


def verified_evidence(spark: SparkSession, records: DataFrame, path: str, allowed: list[str] | None = None) -> DataFrame:
    """Evidence records (evidence_id, content_sha256) with their bodies (<id>.body): text, and the state of ``integrity``."""
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.body").load(path)
    bodies = bodies.select(F.regexp_extract("path", r"([^/]+)\.body$", 1).alias("evidence_id"), "content")
    may = F.lit(True) if allowed is None else F.col("evidence_id").isin(allowed)
    out = records.withColumn("_sha", F.col("content_sha256")).join(bodies, "evidence_id", "left").withColumn("allowed", may)
    return integrity(out).withColumnRenamed("_sha", "content_sha256").select(*records.columns, "state", "text")


def write_verified(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Write as parquet (zstd) or JSON lines, read back and compare as bags of rows; raises on any difference."""
    w = df.write.mode("errorifexists")
    w.option("compression", "zstd").parquet(path) if kind == "parquet" else w.option("ignoreNullFields", "false").json(path)
    spark = df.sparkSession
    back = spark.read.schema(df.schema).parquet(path) if kind == "parquet" else spark.read.schema(df.schema).json(path)
    # one grouped count of row hashes over both sides, each read once
    row = lambda d, sign: d.select(F.sha2(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}), 256).alias("h"), F.lit(sign).alias("n"))
    if not row(df, 1).union(row(back, -1)).groupBy("h").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty():
        raise ValueError(f"{path}: what was read back differs")
    return back


def grammar_scan(inventory: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """File inventory with the parts of each path; raises for a file that doesn't follow the directory grammar."""
    ok = F.col("path").rlike(pattern)
    parts = [F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return inventory.select("*", *parts).withColumn("path", F.when(ok, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unexpected file "), "path"))))


def tree_digest(inventory: DataFrame, buckets: int = 1024) -> DataFrame:
    """One row: the digest of all (path, sha256), by buckets of the path first, so any number of files fits."""
    b = inventory.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b"), F.concat_ws(" ", "path", "sha256").alias("line"))
    b = b.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    return b.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256)).alias("digest"))


def reused_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their recorded response by commitment; ``cached`` tells. Nothing is called from here."""
    return requests.join(responses.withColumn("cached", F.lit(True)), "commitment", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def markdown_table(report: DataFrame, most: int = 200) -> str:
    """A small report as Markdown, columns in order; raises beyond ``most`` rows."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report has few rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = [report.columns, ["---"] * len(report.columns)]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in [*head, *rows])
