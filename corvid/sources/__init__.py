"""Sources and sinks: tables by name, JSON inputs, landed pages, staged publishing and logs without query texts."""

from __future__ import annotations

import json as json_
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The corpus; ord is a row's place in the concatenated lists and breaks all ties.
CHUNKS = (
    "ord long, id string, sourceId string, chapter string, page string, sourceUrl string, citationStatus string, excerptType string, role string, topics array<string>, keywords array<string>, "
    "text string, quranText string, quranReference string, hadithText string, hadithFullText string, explanationText string, explanationSourceUrl string, htmlIngestion struct<method: string, sourcePage: string, fetchedAt: string>"
)
SOURCES = (
    "id string, slug string, title string, author string, category string, publisher string, registryUrl string, originalUrl string, status string, approvedBy string, approvedAt string, notes string, "
    "verificationUrl string, verificationLabel string, showInLibrary boolean"
)
EXCLUDED = ("title string, reason string")
TOPICS = ("id string, slug string, order int, title string, description string, synonyms array<string>, keywords array<string>, related array<string>, relatedQuestions array<string>")
CASES = ("id string, type string, query string, expectedOutcome string, expectedSources array<string>, expectedTopics array<string>, expectedChunks array<string>, notes string")
MANIFEST = (
    "sourceId string, baseUrl string, maxSubjectResults int, requestDelayMs int, fallbackDelayMs int, timeoutMs int, fetchAttempts int, maxCommentaryFetches int, maxExplanationChars int, minimumChunks int, minimumChunksPerTopic int, "
    "jinaFallback boolean, requiredTopicIds array<string>, targets array<struct<kind: string, url: string, label: string, topicIds: array<string>>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file holding one object or an array of them."""
    return spark.read.schema(schema).json(path, multiLine=True)


def rows(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    """Small constant tables (lists in code or of tests); ord counts from 0 where the schema has it and an item doesn't."""
    names = T._parse_datatype_string(schema).fieldNames()
    return spark.createDataFrame([tuple({"ord": k, **item}.get(n) for n in names) for k, item in enumerate(items)], schema)


def corpus(parts: list[DataFrame]) -> DataFrame:
    """Concatenated lists: each part's ord follows those before it. One aggregate a part gives the offsets."""
    base, out = 0, None
    for p in parts:
        q = p.withColumn("ord", F.col("ord") + base)
        out = q if out is None else out.unionByName(q, allowMissingColumns=True)
        last = p.agg(F.max("ord")).first()[0]
        base += 0 if last is None else last + 1
    return out


def index_entries(entries: DataFrame, prefix: str, source_id: str, template: str) -> DataFrame:
    """Index chunks made of (n, title, url, topics, keywords): numbered ids and a templated text with one %s for the title."""
    return entries.select((F.col("n") - 1).alias("ord"), F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 3, "0")).alias("id"), F.lit(source_id).alias("sourceId"), F.col("title").alias("chapter"), F.col("url").alias("sourceUrl"), F.lit("index").alias("role"), F.lit("curated-summary").alias("excerptType"), "topics", "keywords", F.format_string(template, "title").alias("text"))


def landed(direct: DataFrame, mirror: DataFrame, valid, html: str = "html") -> DataFrame:
    """Pages (url, html) with a fallback: the direct copy if valid(column), else a valid mirror's; method says which."""
    x = direct.select("url", F.col(html).alias("d")).join(mirror.select("url", F.col(html).alias("m")), "url", "full")
    ok = lambda c: F.coalesce(valid(F.col(c)), F.lit(False))
    return x.select("url", F.when(ok("d"), F.col("d")).when(ok("m"), F.col("m")).alias(html), F.when(ok("d"), "direct").when(ok("m"), "mirror").alias("method"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def within_limit(requests: DataFrame, body: str, most: int = 8192) -> DataFrame:
    """Requests whose body has at most `most` bytes."""
    return requests.where(F.octet_length(F.coalesce(F.col(body), F.lit(""))) <= most)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets one of its own; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvid-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


class Kept:
    """Tables that several joins of an operator read, written once to the shared folder: plans stay short, and lost executors cost nothing.

    They are deleted by close(), or at the end of a with block, once nothing reads the operator's result any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/corvid/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Snapshots:
    """A table in versions, each in a folder of its own, and numbered pointer files, the last of which names the present one.

    A new version is written beside the others, and then a pointer appears by one rename to a name that wasn't there, so that a reader finds
    the old version or the new one, whole, at any moment. A pointer also holds the version's number of rows and a note of the writer's. Old
    versions stay for readers that have begun, until prune(). Of two writers at once, the second to point takes the next number.
    """

    POINTER = re.compile(r"present-(\d{12})")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self) -> dict | None:
        """What the last pointer holds (version, rows, note), or None before the first version. A pointer that can't be read is an error."""
        last = max(self._numbers(), default=None)
        if last is None:
            return None
        fs, p = _path(self.spark, f"{self.path}/present-{last:012}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json_.loads(text)

    def _names(self) -> list[str]:
        fs, p = _path(self.spark, self.path)
        return [status.getPath().getName() for status in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return [int(m[1]) for name in self._names() if (m := self.POINTER.fullmatch(name))]

    def read(self) -> DataFrame | None:
        """The present version; None before the first."""
        now = self.state()
        return None if now is None else self.spark.read.parquet(f"{self.path}/{now['version']}")

    def rows(self) -> int:
        now = self.state()
        return 0 if now is None else now["rows"]

    def stage(self, df: DataFrame, **metrics: Column) -> tuple[str, dict]:
        """Write a version that nothing points to yet: its name, and its number of rows and the metrics, observed while it is written."""
        seen = Observation()
        version = f"v-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())).write.parquet(f"{self.path}/{version}")
        return version, seen.get

    def point(self, version: str, rows_: int, note: dict | None = None) -> None:
        """Make a staged version the present one."""
        text = json_.dumps({"version": version, "rows": rows_, "note": note or {}})
        fs, new = _path(self.spark, f"{self.path}/.pointer-{uuid.uuid4().hex}")
        out = fs.create(new)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for _ in range(100):
            target = f"{self.path}/present-{max(self._numbers(), default=0) + 1:012}"
            try:
                return context.rename(new, jvm.org.apache.hadoop.fs.Path(target), options)
            except Py4JJavaError as e:  # another writer took the number
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
        raise OSError(f"{self.path}: no pointer could be placed")

    def drop(self, version: str) -> None:
        delete(self.spark, f"{self.path}/{version}")

    def publish(self, df: DataFrame, note: dict | None = None) -> str:
        """A new present version. An empty table is never published: it is an error, and the old version stays."""
        version, seen = self.stage(df)
        if not seen["rows"]:
            self.drop(version)
            raise ValueError(f"{self.path}: an empty table is not published")
        self.point(version, seen["rows"], note)
        return version

    def prune(self) -> None:
        """Delete all versions but the present one, and their pointers."""
        now, last = self.state(), max(self._numbers(), default=0)
        for name in self._names():
            m = self.POINTER.fullmatch(name)
            if (m and int(m[1]) < last) or (name.startswith("v-") and (now is None or name != now["version"])):
                delete(self.spark, f"{self.path}/{name}")


def existing_rows(spark: SparkSession, path: str) -> int:
    """Rows of a published table; 0 before the first version. A table that can't be read is an error."""
    return Snapshots(spark, path).rows()


def publish(df: DataFrame, path: str) -> None:
    Snapshots(df.sparkSession, path).publish(df)


def publish_or_reject(rows_: DataFrame, reason: str | None, path: str, rejected: str) -> bool:
    """Publish an accepted run; a rejected one goes to its own folder and leaves the published table alone."""
    if reason is None:
        publish(rows_, path)
        return True
    rows_.withColumn("rejected_because", F.lit(reason)).write.mode("append").parquet(rejected)
    return False


def result_path(full: str, partial: str, cases: DataFrame, total: int) -> str:
    """A sample of the cases never overwrites the full run's results."""
    return full if cases.count() == total else partial


def session_log(results: DataFrame, topic_ids: Column | str = "topic_ids") -> DataFrame:
    """Derived fields of results for the log; never the query."""
    return results.select(F.lit(None).cast("string").alias("query"), "outcome", F.col(topic_ids).alias("topic_ids") if isinstance(topic_ids, str) else topic_ids.alias("topic_ids"), "keywords", "passage_ids", F.size("passage_ids").alias("passage_count"), (F.col("outcome") == "safety").alias("safety_triggered"), F.current_timestamp().alias("created_at"))


def append_log(results: DataFrame, path: str) -> None:
    session_log(results).write.mode("append").parquet(path)
