"""Scans and sinks: files to documents, JSON lines, questions, results."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import ship
from .parsers import EXTENSIONS, PARSERS, SECTION, parse

DOCUMENT = f"id string, source string, corpus string, title string, sections array<{SECTION}>, metadata map<string,string>, raw_token_count bigint"
QUESTION = (
    "question_id string, tier int, type string, hops int, question string, answer string, source_refs array<string>, required_entities array<string>, "
    "must_mention array<string>, must_not_claim array<string>"
)
_NAME = re.compile(r"[a-zA-Z0-9_-]+")


def corpus_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a corpus name: {name!r}")
    return name


def read_documents(spark: SparkSession, path: str, corpus: str, kind: str = "auto") -> DataFrame:
    """All known files below ``path`` as documents; files that fail to parse become rows without sections.

    Files are read and parsed where they lie, one a row; nothing is gathered.
    """
    corpus_name(corpus)
    files = scan(spark, path).withColumn("kind", F.lit(kind) if kind != "auto" else kind_of("path", EXTENSIONS))
    return parsed(files.filter(F.lower(extension("path")).isin(*EXTENSIONS)), corpus)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def extension(path: str) -> Column:
    return F.regexp_extract(path, "(\\.[A-Za-z0-9]+)$", 1)


def kind_of(path: str, formats: dict[str, str]) -> Column:
    """The format of a file by its extension; null where it is not known."""
    pairs = [F.lit(x) for pair in formats.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(extension(path)))


def parsed(files: DataFrame, corpus: str) -> DataFrame:
    """Documents of ``files(path, content, kind)``, each parsed by its kind."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(files.sparkSession)
    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], DOCUMENT).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, content, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    found = [asdict(s) for s in parse(content, kind)]
                    error = ""
                except Exception as e:  # a bad file must not end the scan
                    found, error = [], f"{type(e).__name__}: {e}"[:500]
                words = sum(len(s["content"].split()) for s in found)
                rows.append({"id": name, "source": p, "corpus": corpus, "title": found[0]["title"] if found else name, "sections": found, "metadata": [("error", error)] if error else [], "raw_token_count": int(words * 1.3)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content", "kind").mapInArrow(run, DOCUMENT)


#: Characters of texts whose sections are held as objects at a time.
HELD_CHARS = 1_000_000


def sections_of(frame: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """A row for each section that the parser of ``kind`` finds in a column of texts.

    Keeps the other columns; ``pos`` counts a text's sections and ``section`` is one of them. Texts are parsed where they
    lie; null texts, and those that cannot be parsed, have no sections.
    """
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(frame.sparkSession)
    form = to_arrow_schema(frame.sparkSession.createDataFrame([], f"s array<{SECTION}>").schema).field("s").type

    @arrow_udf(f"array<{SECTION}>")
    def run(texts: pa.Array) -> pa.Array:
        parts, found, size = [], [], 0
        for value in texts:
            text = value.as_py()
            try:
                found.append([asdict(s) for s in PARSERS[kind](text)] if text is not None else [])
            except Exception:  # a bad text must not end the scan
                found.append([])
            size += len(text or "") + 1
            if size >= HELD_CHARS:  # sections take many times their text until they are packed
                parts.append(pa.array(found, form))
                found, size = [], 0
        return pa.concat_arrays([*parts, pa.array(found, form)])

    others = [c for c in frame.columns if c != text_col]
    return frame.withColumn(text_col, run(text_col)).select(*others, F.posexplode(text_col).alias("pos", "section"))


# Folders that a repository scan leaves out, and the formats that it reads.
SKIPPED_FOLDERS = [".git", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "venv", ".venv", "dist", "build", ".eggs"]
REPOSITORY_FORMATS = {".md": "markdown", ".markdown": "markdown", ".rst": "markdown", ".txt": "text", ".html": "html", ".htm": "html"}


def read_repository(spark: SparkSession, path: str, corpus: str, prefix: str = "") -> DataFrame:
    """Documents of a checked-out repository in order of their path in it, which gives source and id.

    Files in a skipped folder, at any depth, and of other formats are not parsed; files without sections give no row.
    ``prefix`` names a remote repository.
    """
    corpus_name(corpus)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    inner = lambda column: F.substr(column, F.lit(len(root) + 2))
    files = scan(spark, path).withColumn("kind", kind_of("path", REPOSITORY_FORMATS)).filter("kind is not null")
    folders = F.split(inner(F.col("path")), "/")
    kept = files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    docs = parsed(kept, corpus).filter(F.size("sections") > 0).withColumn("source", inner(F.col("source"))).orderBy("source")
    named = docs.withColumn("id", tx.slugify(F.col("source")))
    return named.withColumn("source", F.concat(F.lit(f"{prefix}/"), "source")) if prefix else named


def write_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Processed documents; malformed lines are skipped."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)


def read_questions(spark: SparkSession, path: str, tier: int = 0, kind: str = "") -> DataFrame:
    """Question files (YAML lists) in order of name; tier 0 and an empty type mean all."""
    import yaml

    rows = []
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(path).orderBy("path")
    for f in files.collect():  # a benchmark's questions, written by hand
        for q in yaml.safe_load(f["content"].decode()) or []:
            if isinstance(q, dict) and "question" in q:
                limits = q.get("constraints") or {}
                truth = q.get("ground_truth") or {}
                rows.append((str(q["id"]), int(q.get("tier", 0)), str(q.get("type", "")), int(q.get("hops", 1)), q["question"], truth.get("answer", ""), list(truth.get("source_refs") or []), list(truth.get("required_entities") or []), list(limits.get("must_mention") or []), list(limits.get("must_not_claim") or [])))
    found = spark.createDataFrame(rows, QUESTION)
    return found.filter((F.lit(tier) == 0) | (F.col("tier") == tier)).filter((F.lit(kind) == "") | (F.col("type") == kind))


def corpora_with_questions(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of ``path`` that hold question files, in order."""
    try:
        found = spark.read.format("binaryFile").load(f"{path}/*/questions/*.yaml").select("path")
    except AnalysisException:  # no such file
        return []
    names = found.select(F.regexp_extract("path", "([^/]+)/questions/[^/]+$", 1).alias("corpus")).distinct()
    return sorted(r["corpus"] for r in names.collect())


def read_all_questions(spark: SparkSession, path: str, tier: int = 0, kind: str = "") -> DataFrame:
    """The questions of every corpus below ``path``, with the corpus; no corpus gives no rows."""
    empty = spark.createDataFrame([], f"{QUESTION}, corpus string")
    for name in corpora_with_questions(spark, path):
        empty = empty.unionByName(read_questions(spark, f"{path}/{name}/questions", tier, kind).withColumn("corpus", F.lit(name)))
    return empty


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file, wherever ``path`` points."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


# The file of each tier's questions.
TIER_FILES = {1: "tier1_factoid", 2: "tier2_procedural", 3: "tier3_comparative", 4: "tier4_relational", 5: "tier5_multihop"}


def write_questions(questions: DataFrame, path: str) -> None:
    """A YAML list for each tier of ``questions`` as ``read_questions`` gives them; of a benchmark, thus small."""
    import yaml

    tiers: dict[int, list[dict]] = {}
    for q in questions.orderBy("question_id").collect():
        item = {"id": q["question_id"], "tier": q["tier"], "type": q["type"], "hops": q["hops"], "question": q["question"]}
        item["ground_truth"] = {"answer": q["answer"], "source_refs": q["source_refs"], "required_entities": q["required_entities"]}
        item["constraints"] = {"must_mention": q["must_mention"], "must_not_claim": q["must_not_claim"]}
        tiers.setdefault(q["tier"], []).append(item)
    for tier, items in tiers.items():
        put(questions.sparkSession, f"{path}/{TIER_FILES.get(tier, f'tier{tier}')}.yaml", yaml.safe_dump(items, sort_keys=False, allow_unicode=True))


def write_labels(labels: DataFrame, path: str) -> None:
    """``labels(question_id, expected_id)`` as one YAML map, questions and ids in order."""
    import yaml

    per = labels.groupBy("question_id").agg(F.array_sort(F.collect_set("expected_id")).alias("ids"))
    put(labels.sparkSession, path, yaml.safe_dump({r["question_id"]: r["ids"] for r in per.collect()}, sort_keys=True))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, expected_id) of a YAML map from question to ids."""
    import yaml

    held = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or {}
    return spark.createDataFrame([(str(q), str(i)) for q, ids in held.items() for i in ids or []], "question_id string, expected_id string")


def read_result_files(spark: SparkSession, path: str, strategies: list[str], corpus: str = "all", run_id: str = "") -> DataFrame:
    """Result files ``{corpus}_{strategy}.json`` of a folder, or of one of its runs, with corpus and strategy.

    Files of other names are left out. Corrupt files give no row.
    """
    folder = f"{path}/run_{run_id}" if run_id else path
    name = F.col("_metadata.file_name")
    pattern = f"^(.+)_({'|'.join(map(re.escape, strategies))})\\.json$"
    found = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*.json")
    named = found.withColumns({"corpus": F.regexp_extract(name, pattern, 1), "strategy": F.regexp_extract(name, pattern, 2)})
    return named.filter((F.col("corpus") != "") & ((F.lit(corpus) == "all") | (F.col("corpus") == corpus)))


def write_results(records: DataFrame, path: str, run_id: str) -> None:
    """One folder for each run, and the latest."""
    records.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    records.write.mode("overwrite").parquet(f"{path}/latest")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The union with the last row of each key."""
    from pyspark.sql import Window

    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth", "_new")


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 3, limit: int = 50) -> DataFrame:
    """Breadth-first reach over a table of links (source, target) on the seeds' hosts; the first ``limit`` pages."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    front = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    hosts = front.select(host.alias("host")).distinct()
    seen = front
    for d in range(1, depth + 1):
        following = front.join(links.withColumnRenamed("source", "url"), "url").select(F.regexp_replace("target", "[?#].*$", "").alias("url")).distinct()
        following = following.withColumn("host", host).join(hosts, "host", "left_semi").drop("host")
        front = following.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return pages.join(seen, "url").orderBy("depth", "url").limit(limit)


# Fixed value: a site's guide is longer than this.
GUIDE_CHARS = 50


def entry_url(spark: SparkSession, path: str) -> str | None:
    """The URL that ``path`` is or that the file there holds, else None."""
    found = path
    if not path.startswith(("http://", "https://")):
        try:
            found = spark.read.text(path, wholetext=True).first()["value"].strip()
        except (AnalysisException, TypeError):  # no such file, or an empty folder
            return None
    return found if found.startswith(("http://", "https://")) else None


def site_documents(pages: DataFrame, links: DataFrame, seeds: DataFrame, guides: DataFrame, corpus: str, depth: int = 3, limit: int = 50) -> DataFrame:
    """Documents of the sites of ``seeds(url)``.

    A host with a guide for language models, ``guides(host, text)`` of more than 50 characters, is that guide, parsed as
    Markdown; the others are crawled over ``links(source, target)`` and give their ``pages(url, html)``.
    """
    host = lambda url: F.regexp_extract(url, "^https?://([^/]+)", 1)
    stated = seeds.withColumn("host", host("url"))
    usable = guides.filter(F.length("text") > GUIDE_CHARS).groupBy("host").agg(F.min("text").alias("text"))
    guided = stated.join(usable, "host").groupBy("host").agg(F.min("url").alias("path"), F.first("text").alias("text"))
    read = parsed(guided.select("path", F.encode("text", "UTF-8").alias("content"), F.lit("markdown").alias("kind")), corpus)
    described = lambda kind: F.create_map(F.lit("source_type"), F.lit(kind), F.lit("url"), F.col("source"))
    read = read.withColumn("id", tx.slugify(host("source"))).withColumn("metadata", F.map_concat("metadata", described("llms.txt")))
    reached = crawl(pages, links, stated.join(usable, "host", "left_anti"), depth, limit)
    crawled = parsed(reached.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), F.lit("web").alias("kind")), corpus)
    crawled = crawled.withColumn("id", tx.slugify(F.regexp_replace("source", "^https?://", ""))).withColumn("metadata", F.map_concat("metadata", described("web")))
    return read.unionByName(crawled)
