"""Explicit schemas of the application's tables and readers for them; nothing is inferred."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: table -> DDL of its columns
SCHEMAS = {
    "student": "student_id long, name string, email string, date_of_birth date, nationality string, state string, gender string, account_status string",
    "education": "education_id long, student_id long, qualification string, specialization string, cgpa double, percentage double, current_year int, year_of_passing int, is_current boolean, is_higher_qualification boolean",
    "work_experience": "work_experience_id long, student_id long, duration string",
    "conducting_body": "body_id long, name string",
    "exam": "exam_id long, body_id long, name string, type string, description string, status string",
    "officialnotification": "notification_id long, exam_id long, release_date date, application_start_date date, application_end_date date, document_url string, document_hash string, approval_status string",
    "examdate": "exam_date_id long, notification_id long, start_date date, end_date date",
    "eligibilityrulegroup": "group_id long, notification_id long, parent_group_id long, group_number int, logical_operator string",
    "eligibilityrule": "rule_id long, group_id long, attribute_id long, operator string, value string",
    "eligibilityattribute": "attribute_id long, attribute_name string, source_table string, source_column string, data_type string",
    "studentexameligibility": "eligibility_id long, student_id long, exam_id long, status string, reason string, evaluated_at timestamp_ntz",
    "trackedexam": "tracking_id long, student_id long, exam_id long, tracking_status string, tracked_at timestamp_ntz",
    "notification": "id long, student_id long, exam_id long, type string, message string, dedupe_key string, email_status string, is_read boolean, created_at timestamp_ntz",
    "extractionhistory": "extraction_id long, notification_id long, extracted_content string, status string, created_at timestamp_ntz",
    "monitoringreview": "review_id long, notification_id long, old_hash string, new_hash string, change_report string, review_status string, created_at timestamp_ntz",
    "auditlog": "audit_id long, admin_id long, entity_type string, entity_id long, action string, old_value string, new_value string, created_at timestamp_ntz",
    "admin": "admin_id long, email string",
    "pending_signup": "pending_id long, email string, expires_at timestamp_ntz, attempts int, send_count int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; declared tables are read under their schema."""
    reader = spark.read.schema(schema(name)) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def load_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """The live table, read in parallel by ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a primary key: an equality filter that reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def with_children(parents: DataFrame, children: DataFrame, key: str, into: str, order: str) -> DataFrame:
    """Every parent with the array of its children, ordered; one join, never one query for each parent."""
    fields = [c for c in children.columns if c != key]
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(into))
    return parents.join(grouped, key, "left").withColumn(into, F.coalesce(into, F.array().cast(grouped.schema[into].dataType)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file in file order: a byte-order mark, blank lines and # comments dropped, the first of equal names kept."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("name"))
    named = lines.where("name <> '' and not startswith(name, '#')").withColumn("key", F.lower("name"))
    return named.groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))


def read_results(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A results CSV with a header, under a schema given in DDL."""
    return spark.read.schema(columns).option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows: path, content, SHA-256 and whether they begin as a PDF does."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.expr("startswith(content, X'255044462D')").alias("is_pdf"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local one only where the session names none and runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the session's process ends: nothing that reads it outlives that."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for what several branches of a plan read; it goes with the session."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
