"""Sinks: flat exports, CSV, sessions, logs."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions import contacts as C
from bookmerge.functions import normalize as N
from bookmerge.operators import store
from bookmerge.operators.logs import with_display
from bookmerge.operators.versions import dropped_sessions


def _slots(c) -> list[tuple[str, Column]]:
    text = lambda v: F.coalesce(v, F.lit(""))
    at = lambda f, i: F.get(c[f], F.lit(i))
    many = lambda f, title, n: [x for i in range(n) for x in ((f"{title} {i + 1} Type", text(at(f, i)["label"])), (f"{title} {i + 1} Value", text(at(f, i)["value"])))]
    name = F.array_join(F.array_compact(F.array(*(N.non_blank(c[f]) for f in ("given_name", "middle_name", "family_name")))), " ")
    plain = [("Given Name", "given_name"), ("Middle Name", "middle_name"), ("Family Name", "family_name"), ("Name Prefix", "name_prefix"), ("Name Suffix", "name_suffix"), ("Nickname", "nickname")]
    address = [("Type", "label"), ("Street", "street"), ("City", "city"), ("State", "state"), ("Postal Code", "postal_code"), ("Country", "country")]
    work = [("Organization", "organization"), ("Job Title", "job_title"), ("Department", "department")]
    return [
        ("Name", name), *((t, text(c[f])) for t, f in plain), *many("emails", "Email", 3), *many("phones", "Phone", 3),
        *((f"Address 1 {t}", text(at("addresses", 0)[f])) for t, f in address), *((t, text(c[f])) for t, f in work),
        *((f"Website {i + 1}", text(at("urls", i)["value"])) for i in range(2)), ("Birthday", text(N.partial_date_text(c["birthday"]))), ("Notes", text(c["note"])),
    ]


def flat_export_left(df: DataFrame) -> DataFrame:  # K01
    """33 text columns; a missing slot is empty."""
    return df.select(*(v.alias(t) for t, v in _slots(C.HERE)), F.coalesce("google_resource_name", F.lit("")).alias("Google Resource Name"))


def flat_export_right(df: DataFrame) -> DataFrame:  # K02
    return df.select(*(v.alias(t) for t, v in _slots(C.HERE)), F.coalesce("mac_contact_identifier", F.lit("")).alias("Contact ID"))


def write_csv(df: DataFrame, path: str) -> None:  # K03
    """Fields quoted where they hold a comma, a quote or a line break; quotes doubled; nothing trimmed."""
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


class SessionStore:  # K05
    """Snapshot sessions in a folder: bodies, a summary of each session and its highest version numbers.

    The three are written aside and read back; then one manifest names them, so they appear together or not at all. A
    session that is written again replaces the one of its id. Only what the manifest names is read.
    """

    PARTS = ("body", "summary", "highest")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def published(self) -> dict[str, str]:
        """The write that holds each session, by the name of its folder."""
        return (store.published(self.spark, f"{self.path}/manifest.json") or {"sessions": {}})["sessions"]

    def write(self, versions: DataFrame) -> list[str]:
        """versions (session_id, contact_identifier, version_number, ...; timestamp and source where there are); the folders of the sessions."""
        write = f"write={uuid.uuid4().hex}"
        at = lambda part: f"{self.path}/{part}/{write}"
        has = versions.columns
        versions.write.partitionBy("session_id").parquet(at("body"))
        rows = self.spark.read.schema(versions.schema).parquet(at("body"))
        count = lambda side: (F.count_if(F.col("source") == side) if "source" in has else F.lit(None)).cast("int")
        when = F.max("timestamp") if "timestamp" in has else F.lit(None).cast("timestamp")
        rows.groupBy("session_id").agg(when.alias("timestamp"), count("google").alias("google_count"), count("mac").alias("mac_count"), F.count("*").cast("int").alias("version_count")).write.partitionBy("session_id").parquet(at("summary"))
        rows.groupBy("session_id", "contact_identifier").agg(F.max("version_number").alias("version_number")).write.partitionBy("session_id").parquet(at("highest"))
        found = {part: [n for n in store.names(self.spark, at(part)) if n.startswith("session_id=")] for part in self.PARTS}
        told = self.spark.read.parquet(at("summary")).agg(F.sum("version_count")).first()[0] if found["summary"] else 0
        if not found["body"] == found["summary"] == found["highest"] or told != rows.count():
            raise OSError(f"session files of {write} are not whole")
        store.publish(self.spark, f"{self.path}/manifest.json", {"sessions": {**self.published(), **{n: write for n in found["body"]}}})
        return found["body"]

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{write}/{session}" for session, write in self.published().items()]
        schema = f"{schema}, session_id string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, write string").option("basePath", f"{self.path}/{part}").parquet(*paths).drop("write")

    def bodies(self, schema: str) -> DataFrame:
        """Rows of ``schema`` (without session_id) and session_id of all published sessions."""
        return self._read("body", schema)

    def summaries(self) -> DataFrame:
        return self._read("summary", "timestamp timestamp, google_count int, mac_count int, version_count int")

    def highest(self) -> DataFrame:
        """(contact_identifier, version_number) over all published sessions."""
        return self._read("highest", "contact_identifier string, version_number int").groupBy("contact_identifier").agg(F.max("version_number").alias("version_number"))

    def retain(self, keep: int) -> list[str]:
        """Only the newest sessions stay published; the others' files go afterwards. The folders that went."""
        dropped = {str(r[0]) for r in dropped_sessions(self.summaries().select(F.col("session_id").alias("id"), "timestamp"), keep).select("id").collect()}
        now = self.published()
        gone = {k: v for k, v in now.items() if unquote(k.removeprefix("session_id=")) in dropped}
        store.publish(self.spark, f"{self.path}/manifest.json", {"sessions": {k: v for k, v in now.items() if k not in gone}})
        for session, write in gone.items():
            for part in self.PARTS:
                store.remove(self.spark, f"{self.path}/{part}/{write}/{session}")
        return sorted(gone)


def session_json(sessions: DataFrame) -> DataFrame:  # K06
    """One JSON text a session, keys in order, ISO times."""
    return sessions.select(F.to_json(F.struct(*sorted(sessions.columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("value"))


def export_session(sessions: DataFrame, path: str) -> None:
    session_json(sessions).write.text(path)


def export_log(events: DataFrame, path: str, redact: bool = True) -> None:  # K07
    (with_display(events) if redact else events).write.json(path)
