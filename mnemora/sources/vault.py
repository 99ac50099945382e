"""Readers of a vault: Markdown notes, day logs, state maps, queue and feedback files, facts of a project.

Paths are relative to the vault's root (``rel``). A folder or file that isn't
there reads as an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import fixed
from mnemora.functions import text as tx
from mnemora.sources import tables

FILE_SCHEMA = "rel string, name string, stem string, text string, modified timestamp"
HEARTBEAT_SCHEMA = "slug string, at string, reason string, session_id string, project_root string"
FEEDBACK_SCHEMA = "id string, type string, confidence double, text string, session_id string, project string, trigger string, captured_at string, status string, promoted_to string"
TASK_SCHEMA = "id string, type string, enqueued_at string, attempts int, last_attempt_at string, payload map<string,string>"
TAIL, TRANSCRIPTS = 60_000, ("jsonl", "json", "txt", "log")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def bare(path: str) -> str:
    """A path without scheme and last slash."""
    return path.split("://", 1)[-1].rstrip("/") if "://" in path else path.removeprefix("file:").rstrip("/")


def files(spark: SparkSession, root: str, under: str = "", glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """One row a file under ``root``/``under``: rel, name, stem, text, modified."""
    path = f"{root.rstrip('/')}/{under}".rstrip("/")
    if not exists(spark, path):
        return spark.createDataFrame([], FILE_SCHEMA)
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(path, wholetext=True)
    meta = lambda c: F.col(f"_metadata.{c}")
    full, start = F.url_decode(F.replace(meta("file_path"), F.lit("+"), F.lit("%2B"))), bare(root) + "/"
    rel = F.expr(f"substring(full, instr(full, '{start}') + {len(start)})")
    rows = raw.select(full.alias("full"), meta("file_modification_time").alias("modified"), F.col("value").alias("text"))
    rows = rows.select(rel.alias("rel"), "text", "modified").withColumn("name", F.substring_index("rel", "/", -1))
    return rows.select("rel", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "text", "modified")


@dataclass(frozen=True)
class TreeRule:
    """Which files of a tree a caller leaves out: by name, by a folder of the path, by the status in front matter."""

    names: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    any_case: bool = False

    def __call__(self, pages: DataFrame) -> DataFrame:
        parts = F.split("rel", "/")
        status = F.coalesce("status", F.lit(""))
        if self.any_case:
            status = F.lower(status)
        out = pages
        if self.names:
            out = out.where(~F.col("name").isin(*self.names))
        if self.folders:
            out = out.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(f) for f in self.folders])))
        return out.where(~status.isin(*self.statuses)) if self.statuses else out


RULES = {
    "search": TreeRule(fixed.SEARCH_SKIP_NAMES, fixed.SEARCH_SKIP_FOLDERS, fixed.INACTIVE),
    "graph": TreeRule(statuses=fixed.INACTIVE, any_case=True),
    "lint": TreeRule(fixed.EDITORIAL),
    "tiers": TreeRule(fixed.EDITORIAL, ("_template",)),
    "catalogue": TreeRule(fixed.CATALOGUE_SKIP_NAMES, ("archive",), fixed.INACTIVE),
    "snapshot": TreeRule(folders=("archive",), statuses=("superseded",)),
}


def structured(raw: DataFrame) -> DataFrame:
    """``files`` with the parts of a page: front matter, title, summary, links, words."""
    fm, text = F.col("fm"), F.col("text")
    rows = raw.withColumn("has_fm", text.rlike(r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(\n|\z)")).withColumn("fm", tx.frontmatter(text))
    keys = ("type", "status", "project", "timestamp", "valid_to", "superseded_by", "source_authority")
    return rows.select(
        *raw.columns, "has_fm", "fm", tx.body(text).alias("body"), tx.title(text, F.col("stem")).alias("title"), tx.summary(text).alias("summary"),
        *[tx.field(fm, k).alias(k) for k in keys], tx.wikilinks(text).alias("links"), tx.content_words(text).alias("n_words"),
    )


def notes(spark: SparkSession, root: str, rule: str = "search", under: str = "knowledge/notes") -> DataFrame:
    return RULES[rule](structured(files(spark, root, under)))


def dailies(spark: SparkSession, root: str, under: str = "knowledge/daily") -> DataFrame:
    """Day logs (not in subfolders): rel, name, stem, text, modified, day (null for other names), hash."""
    day = F.when(F.col("stem").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp("stem", F.lit("yyyy-MM-dd"))))
    return files(spark, root, under, recursive=False).withColumn("day", day).withColumn("hash", F.sha2("text", 256))


def select_dailies(days: DataFrame, ledger: DataFrame, name: str | None = None, everything: bool = False) -> DataFrame:
    """Days to compile: one by name, all, or those whose hash the ledger (name, hash) doesn't have."""
    if name is not None:
        return days.where(F.col("name") == name)
    if everything:
        return days
    return days.join(ledger.select("name", "hash").distinct(), ["name", "hash"], "left_anti")


def latest(days: DataFrame) -> DataFrame:
    """The day log whose name is greatest; no rows if there is none."""
    return days.groupBy().agg(F.max_by(F.struct(*days.columns), "name").alias("d")).where("d is not null").select("d.*")


def state_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state file of one JSON object a line; none is empty, lines that don't parse are kept beside it under ``.corrupt``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("value").isNull().alias("bad"))
    bad = parsed.where("bad").select("value")
    if not bad.isEmpty():
        bad.write.mode("overwrite").text(f"{path}.corrupt")
    return parsed.where("not bad").select("row.*")


def feedback(spark: SparkSession, root: str, status: str | None = "candidate", under: str = "knowledge/feedback") -> DataFrame:
    """Feedback, one JSON file each; corrupt files are skipped."""
    path = f"{root.rstrip('/')}/{under}"
    if not exists(spark, path):
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    rows = tables.json_files(spark, path, FEEDBACK_SCHEMA).where("id is not null")
    return rows if status is None else rows.where(F.col("status") == status)


def queue_files(spark: SparkSession, path: str) -> DataFrame:
    """Queued tasks, one JSON file each, oldest first (ids begin with their time); corrupt files are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], TASK_SCHEMA)
    return tables.json_files(spark, path, TASK_SCHEMA).where("id is not null").orderBy("id")


def transcript_tail(spark: SparkSession, paths: list[str], folders: list[str], limit: int = TAIL) -> DataFrame:
    """(path, tail) of transcripts with a known ending under an allowed folder; the last ``limit`` characters."""
    kept = [p for p in paths if p.rsplit(".", 1)[-1] in TRANSCRIPTS and any(bare(p).startswith(bare(f) + "/") for f in folders) and "/../" not in p]
    kept = [p for p in kept if exists(spark, p)]
    if not kept:
        return spark.createDataFrame([], "path string, tail string")
    return spark.read.text(kept, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.right("value", F.lit(limit)).alias("tail"))


def hook_events(lines: DataFrame, schema: str) -> DataFrame:
    """Hook payloads from one text column: what isn't a JSON object is an empty one."""
    shape = F.schema_of_variant(F.try_parse_json("value"))
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    return lines.select(F.when(is_object, F.from_json("value", schema)).otherwise(F.from_json(F.lit("{}"), schema)).alias("e")).select("e.*")


def is_fresh(pages: DataFrame, manifest: DataFrame, built: str | None) -> bool:
    """Whether an index built at ``built`` over ``manifest`` (rel) still covers ``pages``: same paths, none newer."""
    if built is None:
        return False
    now, then = pages.select("rel").distinct(), manifest.select("rel").distinct()
    same = now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()
    return same and pages.where(F.col("modified") > F.lit(built).cast("timestamp")).isEmpty()


def changelog_tail(log: DataFrame, n: int = 3, limit: int = 200) -> DataFrame:
    """One row: the last ``n`` entries of a change log (column text), clipped, marks of a wrong code page left out."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.rtrim(x))
    kept = F.filter(lines, lambda x: x.startswith("- ") & ~tx.is_mojibake(x))
    tail = F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n)
    return log.select(F.array_join(F.transform(tail, lambda x: tx.clip(x, limit)), "\n").alias("block"))


def project_facts(commits: list[str], readme: str | None, names: list[str], packages: list[str], docs: list[str]) -> dict[str, list[str]]:
    """What a new project's page tells: up to 20 commits of note, the read-me's first paragraph, tools, 15 documents."""
    subject = lambda line: (line.split(":", 1)[-1] if " " in line else line).strip().lower()
    told = [f"- `{c.strip()}`" for c in commits[:30] if not any(d in subject(c) for d in fixed.DULL_COMMITS)]
    paragraph: list[str] = []
    for line in map(str.strip, (readme or "").splitlines()):
        if line.startswith("#"):
            continue
        if not line and paragraph:
            break
        if line:
            paragraph.append(line)
        if len(paragraph) == 5:
            break
    stack = [f"- {tool} (`{n}`)" for n, tool in fixed.STACK_MARKERS.items() if n in names]
    stack += [f"- {tool}" for n, tool in fixed.FRAMEWORKS.items() if "package.json" in names and n in packages]
    if readme is None:
        paragraph = ["(no README found)"]
    return {"description": paragraph or [(readme or "")[:500]], "stack": stack, "commits": told[:20], "docs": [f"- `{d}`" for d in sorted(docs)[:15]]}


def is_project(names: list[str], folder: str = "", home: str | None = None) -> bool:
    """Whether a folder with these names is a project; the home folder isn't."""
    if home is not None and bare(folder) == bare(home):
        return False
    return any(n == m or (m.startswith(".") and n.endswith(m)) for m in fixed.PROJECT_MARKERS for n in names)
