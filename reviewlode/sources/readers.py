"""Files in, files out: reviews, metadata, feature sheets, lexicons, caches, sheets and manifests."""

from __future__ import annotations

import json
import os
import platform
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.functions import scalars
from reviewlode.operators import relational
from reviewlode.operators.patterns import Aspect

REVIEW_COLUMNS = "reviewId userName userImage content score thumbsUpCount reviewCreatedVersion at replyContent repliedAt appVersion".split()
#: Columns that identify the reader; they never leave ingestion.
IDENTITY = ("userName", "userImage")
META_SCHEMA = (
    "title string, appId string, description string, summary string, genre string, developer string, released string, lastUpdatedOn string, realInstalls bigint, ratings bigint, "
    "reviews bigint, score double, adSupported boolean, offersIAP boolean, free boolean, histogram array<bigint>, categories array<struct<id:string,name:string>>"
)


class MissingInput(FileNotFoundError):
    """A needed input is absent; the message says what makes it."""


def require(spark: SparkSession, path: str, made_by: str) -> str:
    """The path if it exists, on whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise MissingInput(f"{path} is missing; it is made by {made_by}")
    return path


def require_columns(df: DataFrame, columns: list[str], made_by: str) -> DataFrame:
    """The same rows if all columns are there; the message names those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingInput(f"columns {missing} are missing; they are made by {made_by}")
    return df


def read_reviews(spark: SparkSession, pattern: str) -> DataFrame:
    """Review CSV files, one folder for each app, as text, with the folder as ``app_dir``; quoted line breaks belong to a field."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(pattern)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS], F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("app_dir"), F.col("_metadata.file_path").alias("file_"))


def typed_reviews(raw: DataFrame) -> DataFrame:
    """Cast leniently, without the reader's identity, and once for each identifier: the first folder in order wins."""
    t = raw.drop(*IDENTITY).withColumns(
        {
            "score": F.expr("try_cast(score AS tinyint)"),
            "thumbsUpCount": F.expr("try_cast(thumbsUpCount AS int)"),
            "at": scalars.lenient_timestamp("at"),
            "repliedAt": scalars.lenient_timestamp("repliedAt"),
        }
    )
    once = relational.keep_first(t, ["reviewId"], ["app_dir", "file_"]).drop("file_")
    return once.withColumns({"days_to_reply": scalars.days_between("at", "repliedAt"), "year": F.year("at").cast("smallint"), "quarter": F.quarter("at").cast("tinyint"), "month": F.month("at").cast("tinyint"), "year_month": F.date_format("at", "yyyy-MM")})


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON document for each app; a missing title is the folder, ``free`` defaults to true and the other flags to false."""
    m = spark.read.schema(META_SCHEMA).option("multiLine", True).json(pattern)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return m.select("*", folder.alias("app_dir")).withColumns(
        {
            "app_name": F.coalesce("title", "app_dir"),
            "released_dt": scalars.lenient_timestamp("released"),
            "free": F.coalesce("free", F.lit(True)),
            "adSupported": F.coalesce("adSupported", F.lit(False)),
            "offersIAP": F.coalesce("offersIAP", F.lit(False)),
        }
    )


# What a cell of the feature sheet means.
ABSENT = frozenset(["x", "no", "0", "-", "–", "—", "✗", "✕", "n", "false"])


def feature_value(cell, row_blank: bool) -> float | None:
    """1 present, 0 absent, None not annotated: blank in a blank row is unknown, blank elsewhere absent, any other text present."""
    s = "" if cell is None or cell != cell else str(cell).strip()
    if not s:
        return None if row_blank else 0.0
    return 0.0 if s.lower() in ABSENT else 1.0


def read_feature_sheet(spark: SparkSession, path: str, features: list[str], name: str = "App Name", skip: int = 3) -> DataFrame:
    """A small spreadsheet export: spacer rows, a header, one row for each app; rows without a name are dropped.

    Beside the features come package (given, else of the link), link, rating
    (null if no number), rating_count and downloads as written, and is_annotated.
    """
    import pandas as pd

    sheet = pd.read_csv(path, header=skip, dtype=str, keep_default_na=False)
    text = lambda c: sheet[c].str.strip() if c in sheet else pd.Series([""] * len(sheet))
    out = pd.DataFrame({"app_name": text(name).str.split().str.join(" ")})
    out["link"] = text("Link").replace("", None)
    out["package"] = text("package name").where(text("package name") != "", text("Link").str.extract(r"[?&]id=([^&]+)", expand=False))
    out["rating"] = pd.to_numeric(text("Rating"), errors="coerce")
    out["rating_count"], out["downloads"] = text("Rating Count").replace("", None), text("Downloads").replace("", None)
    cells = pd.DataFrame({f: text(f) for f in features})
    blank = (cells == "").all(axis=1)
    out["is_annotated"] = ~blank
    for f in features:
        out[f] = [feature_value(c, b) for c, b in zip(cells[f], blank)]
    out = out[out["app_name"] != ""]
    rows = [tuple(None if v != v else v for v in r) for r in out.astype(object).to_numpy().tolist()]
    return spark.createDataFrame(rows, "app_name string, link string, package string, rating double, rating_count string, downloads string, is_annotated boolean, " + ", ".join(f"`{f}` double" for f in features))


def read_lexicon(path: str) -> list[Aspect]:
    """Aspects of a YAML lexicon file, with defaults for what is not given."""
    import yaml

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f) or {}
    text = lambda v: [str(x) for x in v or []]
    return [Aspect(n, text(s.get("keywords")), text(s.get("regex_patterns")), text(s.get("promise_keywords")), text(s.get("promise_regex_patterns")), s.get("csv_column")) for n, s in spec.items() if isinstance(s, dict)]


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_small_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file, for results that are small by nature."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


class ScoreCache:
    """Scores by content: a key of text, model and configuration finds earlier results, so that only new texts are scored."""

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path, self.config = spark, path, json.dumps(config, sort_keys=True)

    def key(self, text: str):
        return F.sha2(F.concat_ws("\x1f", F.col(text), F.lit(self.config)), 256)

    def stored(self, columns: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], f"key_ string, {columns}")
        return self.spark.read.schema(f"key_ string, {columns}").parquet(self.path)

    def scored(self, texts: DataFrame, text: str, columns: str, score) -> DataFrame:
        """Every distinct text with its scores; new ones are scored, stored and returned with the old ones."""
        keyed = texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("key_", self.key(text))
        todo = keyed.join(self.stored(columns).select("key_"), "key_", "left_anti")
        names = [c.split()[0] for c in columns.split(",")]
        new = score(todo).select("key_", *names)
        new.write.mode("append").parquet(self.path)
        return keyed.join(self.stored(columns), "key_").drop("key_")

    def keep_only(self, texts: DataFrame, text: str, columns: str) -> None:
        """Forgets scores of texts that are no longer there, or of another configuration."""
        live = texts.select(self.key(text).alias("key_")).distinct()
        fresh = f"{self.path}_{time.time_ns()}"
        self.stored(columns).join(live, "key_", "left_semi").write.parquet(fresh)
        self.clear()
        self._path(fresh).rename(self._hadoop(fresh), self._hadoop(self.path))

    def clear(self) -> None:
        """Forgets all scores."""
        self._path(self.path).delete(self._hadoop(self.path), True)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _path(self, path: str):
        return self._hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration())


class LabelsPresent(RuntimeError):
    """A sheet with human labels would be overwritten."""


def write_sheet(frame, path: str, label_columns: list[str], force: bool = False) -> str | None:
    """A sheet for people to fill in; an old one with labels is backed up with ``force`` and refused without.  Gives the backup's path."""
    import pandas as pd

    backup = None
    if os.path.exists(path):
        old = pd.read_csv(path, dtype=str, keep_default_na=False)
        if any((old[c].str.strip() != "").any() for c in label_columns if c in old):
            if not force:
                raise LabelsPresent(path)
            backup = f"{path}.{time.time_ns()}.bak"
            os.replace(path, backup)
    frame.to_csv(path, index=False)
    return backup


@contextmanager
def manifest(path: str, script: str, **facts):
    """Appends one JSON line with duration, versions and recorded facts when the block ends, also after an error."""
    import pyspark

    record = {"script": script, "facts": dict(facts)}
    start = time.time()
    try:
        yield record["facts"]
        record["ok"] = True
    except BaseException as e:
        record["ok"], record["error"] = False, type(e).__name__
        raise
    finally:
        record |= {"duration_sec": round(time.time() - start, 3), "python": platform.python_version(), "spark": pyspark.__version__}
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record) + "\n")
