"""Sources and sinks of corpora, datasets, ledgers and indexes."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import coerce_options
from siltstone.tables import exists, materialise


RUN_SCHEMA = """run_id string, sample_id string, track string, model_id string, model_name string, provider string, model_tier string, strategy string, rag_enabled boolean,
repeat_index int, question string, prompt string, response_text string, parsed_answer string, correct boolean, retrieval_context_hash string, retrieval_snapshot_id string,
latency_ms double, tokens_used int, metrics map<string, double>, rag_gate_reason string, structured_output_used boolean, error string"""
DATASET_SCHEMA = """id string, sample_id string, track string, split string, question string, options string, answer_key string, reference_answer string, domain string,
proficiency string, source_doc string, page int, metadata map<string, string>, messages array<struct<role: string, content: string>>"""
CHUNK_FILE_SCHEMA = """markdown string, chunks array<struct<markdown: string, type: string, id: string, grounding: struct<box: struct<left: double, top: double, right: double, bottom: double>, page: int>>>,
metadata struct<filename: string, page_count: int>"""


def text_directory(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """source, text of each file; a missing directory is an error."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def of_manifest(files: DataFrame, manifest: DataFrame, suffix: str = ".md") -> DataFrame:
    """The files that a manifest (included_files) lists."""
    listed = manifest.select(F.explode("included_files").alias("source")).filter(F.col("source").endswith(suffix)).distinct()
    return files.join(listed, "source", "left_semi")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of pre-chunked JSON documents, with a default id and their document's metadata."""
    from siltstone.functions.text import section_heading
    from siltstone.operators.prep import contextual, noise_chunks

    rows = spark.read.schema(CHUNK_FILE_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*_response.json").option("recursiveFileLookup", True).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    source = F.coalesce("metadata.filename", "file")
    each = rows.select(source.alias("source"), F.size("chunks").alias("total_chunks"), F.col("metadata.page_count").alias("page_count"), F.posexplode("chunks").alias("chunk_index", "c"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("c.markdown"), r"<a id='[^']+'>\s*</a>\s*", ""), r"(?s)<::.*?::>", ""), r"\n\n\n+", "\n\n"))
    each = each.select("source", F.coalesce("c.id", F.concat_ws("_", "source", F.lit("chunk"), "chunk_index")).alias("chunk_id"), "chunk_index", "total_chunks", "page_count", F.col("c.type").alias("chunk_type"), F.coalesce("c.grounding.page", F.lit(0)).alias("page"), clean.alias("content"))
    kept = noise_chunks(each).withColumn("section", section_heading(F.col("content")))
    return kept.withColumn("content", contextual(F.col("source"), F.col("section"), F.col("content")))


def dataset(spark: SparkSession, path: str, track: str, holdout_only: bool = True) -> DataFrame:
    """Evaluation records of either layout (S05, F01). A legacy record is one with messages: its id is the sample's (without
    one, the first 12 digits of the line's md5), its split is the holdout unless it says another, the last user message is
    the question, and the last assistant message is the reference answer of an open question, and no one's else."""
    rows = spark.read.schema(DATASET_SCHEMA).json(path).withColumn("_line", F.to_json(F.struct("*")))
    last = lambda role: F.coalesce(F.element_at(F.filter("messages", lambda m: m["role"] == role), -1)["content"], F.lit(""))
    said = lambda role: F.when(F.exists("messages", lambda m: m["role"] == role), last(role)).otherwise(F.lit(""))
    legacy = F.col("messages").isNotNull()
    reference = said("assistant") if track == "open_ended" else F.lit(None).cast("string")
    out = rows.select(
        F.when(legacy, F.coalesce("id", "sample_id", F.substring(F.md5("_line"), 1, 12))).otherwise(F.col("sample_id")).alias("sample_id"), F.lit(track).alias("track"), F.when(legacy, F.coalesce("split", F.lit("holdout"))).otherwise(F.col("split")).alias("split"),
        F.when(legacy, said("user")).otherwise(F.col("question")).alias("question"), F.when(F.col("options").startswith("["), F.from_json("options", "array<string>", {"mode": "PERMISSIVE"})).otherwise(coerce_options(F.col("options"))).alias("options"),
        "answer_key", F.when(legacy, reference).otherwise(F.col("reference_answer")).alias("reference_answer"), "domain", "proficiency", "source_doc", "page", "metadata",
    )
    return out.filter("split = 'holdout'") if holdout_only else out


def ledger(spark: SparkSession, path: str, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Run records, one per line (S06), with some of their metrics as columns."""
    runs = spark.read.schema(RUN_SCHEMA).json(path)
    return runs.select("*", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema; a line that is none is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a sample and a snapshot, with their place: file, block of the file, and line of the block."""
    rows = spark.read.schema("sample_id string, snapshot string, meta string").json(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("*", place.alias("_at")).filter("coalesce(sample_id, '') <> '' and coalesce(snapshot, '') not in ('', '{}')")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, snapshot: the last of each sample by file and line, lines without either skipped."""
    return _snapshot_lines(spark, path).groupBy("sample_id").agg(F.max_by("snapshot", "_at").alias("snapshot"))


def snapshot_meta(spark: SparkSession, path: str) -> str | None:
    """The first description of a run, as JSON, on a line that counts; None where there is none."""
    lines = _snapshot_lines(spark, path).filter("coalesce(meta, '') like '{%' and meta <> '{}'")
    return lines.agg(F.min_by("meta", "_at")).first()[0]


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings, line ends made \\n."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), "\r\n?", "\n")).alias(c) for c in rows.columns])


def csv_union(tables: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """Tables under a constant model_id, united by column names, with the models' display names."""
    out = None
    for model, table in tables.items():
        tagged = table.withColumn("model_id", F.lit(model))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.join(F.broadcast(names), "model_id", "left")


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of summary files below path, with their file; unreadable files give none."""
    rows = spark.read.schema(f"rows array<struct<{schema}>>").option("recursiveFileLookup", True).option("pathGlobFilter", "summary_*.json").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.col("_metadata.file_path").alias("_source"), F.explode("rows").alias("r")).select("r.*", "_source")


def latest_file(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The last path by name below a folder that matches."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.agg(F.max("path")).first()[0]


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, those that come first by a seeded hash of the key (S16). The limit is the sample."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def xlsx_rows(content: bytes) -> Iterator[list[str]]:
    """The cells of a workbook's first sheet, row by row: shared and inline strings, and values as they are written."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{{{space['m']}}}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", space)]
        sheet = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{{{space['m']}}}row"):
            cells: dict[int, str] = {}
            for cell in row.findall("m:c", space):
                column = 0
                for letter in re.match(r"[A-Z]*", cell.get("r") or "")[0]:
                    column = column * 26 + ord(letter) - 64
                value = cell.findtext("m:v", "", space)
                if cell.get("t") == "s" and value:
                    # a reference beyond the table is an empty cell
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{{{space['m']}}}t"))
                cells[column or len(cells) + 1] = value.strip()
            yield [cells.get(k, "") for k in range(1, max(cells, default=0) + 1)]


def header_names(cells: list[str]) -> list[str]:
    """Headers in lower case, with underscores for what is neither letter nor digit."""
    return [re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9]+", "_", h.lower())) for h in cells]


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """file, row, values (map of normalised header to text) of each row of each workbook's first sheet that is not blank."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, content in zip(frame["path"], frame["content"]):
                rows = xlsx_rows(content)
                header = header_names(next(rows, []))
                out += [(file, n, dict(zip(header, row))) for n, row in enumerate(rows, 1) if any(row)]
            yield pd.DataFrame(out, columns=["file", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row int, values map<string, string>")


def with_metrics(rows: DataFrame) -> DataFrame:
    """Numbers that are not fields of a record become entries of its metrics; nulls have none."""
    fields = {c.split()[0] for c in RUN_SCHEMA.replace("\n", " ").replace("map<string, double>", "map").split(", ")}
    own = [f.name for f in rows.schema.fields if f.name not in fields and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    entries = [x for c in own for x in (F.lit(c), F.col(c).cast("double"))]
    new = F.create_map(*entries) if own else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    held = F.map_filter(new, lambda _, v: v.isNotNull())
    if "metrics" in rows.columns:
        held = F.map_concat(F.map_filter(F.coalesce("metrics", held), lambda k, _: ~k.isin(own) if own else F.lit(True)), held)
    return rows.withColumn("metrics", held).drop(*own)


def write_ledger(rows: DataFrame, path: str) -> None:
    """Appends records to a ledger that has a folder for each model; the whole folder is the ledger of all."""
    with_metrics(rows).write.mode("append").partitionBy("model_id").json(path)


def write_ragged_csv(tables: list[DataFrame], path: str) -> None:
    """Rows of several tables under the union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A JSON folder for each table of a report."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def ingestion_manifest(chunks: DataFrame, config: dict[str, str]) -> DataFrame:
    """Per source its sha256 and number of chunks, with the configuration's hash (K07). chunks: source, sha256."""
    canonical = F.lit(";".join(f"{k}={v}" for k, v in sorted(config.items())))
    return chunks.groupBy("source").agg(F.first("sha256").alias("sha256"), F.count("*").alias("chunk_count")).withColumn("config_sha256", F.sha2(canonical, 256))


def without_documents(table: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """A collection without the documents of another table."""
    return table.join(removed.select(key).distinct(), key, "left_anti")


def merged_judgements(base: DataFrame, other: DataFrame, key: str = "name") -> DataFrame:
    """Judge rows of two runs side by side."""
    rest = [c for c in base.columns if c != key]
    a = base.select(key, *[F.col(c).alias(f"base_{c}") for c in rest])
    b = other.select(key, *[F.col(c).alias(f"rag_{c}") for c in other.columns if c != key])
    return a.join(b, key, "full")


# --- records, fingerprints and manifests -------------------------------------------------------------------------


def to_records(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Each row as a JSON text, nulls included."""
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("record")
    return rows.select(key, record) if key else rows.select(record)


def from_records(records: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The rows of JSON texts; fields that are missing or null get their default."""
    held = records.select(F.from_json("record", schema).alias("r")).select("r.*")
    return held.select(*[F.coalesce(F.col(c), F.lit((defaults or {})[c])).alias(c) if c in (defaults or {}) else F.col(c) for c in held.columns])


def canonical(values: dict) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(values: dict | list) -> str:
    """sha256 of a configuration, or of a set of templates by name."""
    return hashlib.sha256(canonical(values).encode()).hexdigest()


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes of the files at a path or below it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def folder_sha256(spark: SparkSession, path: str) -> str:
    """One sha256 of a file or of all files of a written folder, whatever their names; empty where there is none."""
    if not exists(spark, path):
        return ""
    return file_sha256(spark, path).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256)).first()[0]


def write_snapshots(snapshots: DataFrame, path: str, meta: dict[str, object]) -> None:
    """A line per sample: sample_id, snapshot, and the same description of the run on each."""
    rows = snapshots.select(F.col("query_id").cast("string").alias("sample_id"), F.to_json(F.struct(*snapshots.columns)).alias("snapshot"), F.lit(canonical({**meta, "config_sha256": fingerprint(meta)})).alias("meta"))
    rows.write.mode("overwrite").json(path)


def run_manifest(spark: SparkSession, experiment: dict, datasets: dict[str, str], kb: str | None = None, snapshots: str | None = None, templates: dict[str, str] | None = None, commit: str = "") -> DataFrame:
    """What a run was made of, as one row (K10): its configuration, the files of its datasets, knowledge base, snapshots
    and templates by fingerprint, and its policy of retrieval."""
    policy = "disabled" if not experiment.get("include_rag", True) else "gated" if experiment.get("rag_gating_enabled", True) else "always"
    named = {
        "git_commit": commit, "experiment": canonical(experiment), "datasets": canonical({k: {"path": v, "sha256": folder_sha256(spark, v)} for k, v in datasets.items()}),
        "kb": canonical({"path": kb or "", "manifest_sha256": folder_sha256(spark, f"{kb}/manifest") if kb else ""}), "retrieval_snapshots": canonical({"path": snapshots, "sha256": folder_sha256(spark, snapshots)} if snapshots else {}),
        "prompt_templates_sha256": fingerprint(templates or {}), "rag_policy": policy,
        "notes": canonical({"baseline_included": bool(experiment.get("include_no_rag", True)), "rag_included": bool(experiment.get("include_rag", True))}),
    }
    return spark.createDataFrame([tuple(named.values())], ", ".join(f"{k} string" for k in named)).withColumn("created_at", F.current_timestamp())


def convert(rows: DataFrame, fields: tuple[str, ...], prefix: str, number: str, path: str, source: str = "") -> DataFrame:
    """Writes strict records (prefix_id, first) of the rows that have every required field as JSON lines, those without
    as skipped rows with their reason, and a manifest of counts and fingerprints, which is returned (K13)."""
    from siltstone.operators.prep import required

    spark = rows.sparkSession
    marked = materialise(required(rows, fields), "convert")
    kept = marked.filter("skip_reason is null").drop("skip_reason").withColumn("sample_id", F.concat(F.lit(f"{prefix}_"), F.col(number).cast("string")))
    kept.select("sample_id", *[c for c in kept.columns if c != "sample_id"]).write.mode("overwrite").json(f"{path}/{prefix}")
    marked.filter("skip_reason is not null").select(F.col(number).cast("string").alias("row"), "skip_reason").write.mode("overwrite").json(f"{path}/{prefix}_skipped")
    out = marked.agg(F.count("*").alias("input_rows"), F.count_if(F.col("skip_reason").isNull()).alias("kept_rows"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_rows"))
    out = out.select(F.lit(prefix).alias("dataset"), F.lit(f"{prefix}_<{number}>").alias("sample_id_scheme"), "*", F.lit(folder_sha256(spark, source) if source else "").alias("input_sha256"), F.lit(folder_sha256(spark, f"{path}/{prefix}")).alias("output_sha256"))
    out.write.mode("overwrite").json(f"{path}/{prefix}_manifest")
    return spark.read.json(f"{path}/{prefix}_manifest")


def write_audit(audit: DataFrame, path: str) -> DataFrame:
    """The matches of a leakage audit and a row of totals (K12): questions asked, suspected, and the best match of any."""
    audit.write.mode("overwrite").json(f"{path}/matches")
    rows = audit.sparkSession.read.json(f"{path}/matches")
    totals = rows.agg(F.countDistinct("query_id").alias("questions"), F.countDistinct(F.when(F.col("suspected"), F.col("query_id"))).alias("suspected"), F.max("jaccard").alias("best_jaccard"), F.count_if("exact").alias("exact_matches"))
    totals.write.mode("overwrite").json(f"{path}/totals")
    return audit.sparkSession.read.json(f"{path}/totals")


def write_judgements(merged: DataFrame, scores: tuple[str, ...], path: str) -> DataFrame:
    """Judge rows side by side as JSON and CSV, and the mean of each score on either side."""
    merged.write.mode("overwrite").json(f"{path}/records")
    merged.write.mode("overwrite").option("header", True).csv(f"{path}/table")
    means = merged.agg(F.count("*").alias("n"), *[F.avg(f"{side}_{m}").alias(f"{side}_{m}_mean") for side in ("base", "rag") for m in scores])
    means.write.mode("overwrite").json(f"{path}/summary")
    return merged.sparkSession.read.json(f"{path}/summary")


def any_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, text, kind of the markdown files below a folder and of its pre-chunked *_response.json, whose chunks are
    joined by blank lines; PDFs are an error, as nothing here reads them (S03)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if listed.filter(F.lower("path").endswith(".pdf")).limit(1).collect():
        raise NotImplementedError("PDF files are not read; convert them to markdown first")
    text = listed.filter(F.lower("path").endswith(".md")).select(F.element_at(F.split("path", "/"), -1).alias("source"), F.decode("content", "UTF-8").alias("text"), F.lit("markdown").alias("kind"))
    if not listed.filter(F.col("path").endswith("_response.json")).limit(1).collect():
        return text
    chunks = chunk_files(spark, path).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n").alias("text"))
    return text.unionByName(chunks.select("source", "text", F.lit("chunked").alias("kind")))
