"""Reading of a mailbox tree: message files with their sidecars, parsed on the executors."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from datetime import timezone
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.text import folder_key

SCHEMA = """eml_path string, voyage_key string, direction string, subject string, from_addr string, to_addr array<string>, cc_addr array<string>, sent_us bigint,
message_id string, in_reply_to string, reference_ids array<string>, body_text string, body_html string, raw_headers map<string,string>, attachments array<struct<file_name:string,mime_type:string,size_bytes:bigint,sha256:string>>, error string"""


def files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, stem, content) of the files of a tree with a suffix."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return df.select("path", F.regexp_replace("path", rf"\{suffix}$", "").alias("stem"), "content")


def pairs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(messages with a sidecar, messages without)."""
    eml, side = files(spark, root, ".eml"), files(spark, root, ".json").select("stem", F.col("content").cast("string").alias("sidecar"))
    return eml.join(side, "stem"), eml.join(side.select("stem"), "stem", "left_anti").select("path")


def _parse(raw: bytes) -> dict:
    import hashlib

    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = {k: str(v) for k, v in m.items()}  # of headers that repeat, the last counts
    low = {k.lower(): v.strip() for k, v in head.items()}
    addresses = lambda k: [a for _, a in getaddresses([str(v) for v in m.get_all(k, [])]) if a]
    sent = None
    if low.get("date"):
        t = parsedate_to_datetime(low["date"])
        sent = round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)  # without zone: UTC
    body = lambda kind: (p.get_content() if (p := m.get_body(preferencelist=(kind,))) else None)
    files_ = []
    for p in m.iter_attachments():
        data = p.get_payload(decode=True) or b""
        files_.append({"file_name": p.get_filename() or "attachment", "mime_type": p.get_content_type(), "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    return {
        "subject": low.get("subject"), "from_addr": low.get("from"), "to_addr": addresses("to"), "cc_addr": addresses("cc"), "sent_us": sent, "message_id": low.get("message-id") or None,
        "in_reply_to": low.get("in-reply-to") or None, "reference_ids": low.get("references", "").split(), "body_text": body("plain"), "body_html": body("html"), "raw_headers": head, "attachments": files_, "error": None,
    }


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, group, direction, raw in zip(b["path"], b["voyage_key"], b["direction"], b["content"]):
            try:
                row = _parse(bytes(raw))
            except Exception as e:  # noqa: BLE001  a file that can't be read becomes a row with its error
                row = {"error": f"{type(e).__name__}: {e}"[:200]}
            rows.append(dict.fromkeys(COLUMNS) | {"eml_path": path, "voyage_key": group, "direction": direction} | row)
        out = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
        out["sent_us"] = out["sent_us"].astype("Int64")
        yield out


COLUMNS = "eml_path voyage_key direction subject from_addr to_addr cc_addr sent_us message_id in_reply_to reference_ids body_text body_html raw_headers attachments error".split()


def read_mailbox(spark: SparkSession, root: str) -> DataFrame:
    """One row per message file under <root>/<folder>/{IN,OUT}/...; files that can't be parsed have only path and error."""
    eml = files(spark, root, ".eml")
    parts = F.split("path", "/")
    side = F.array_max(F.transform(F.array(F.lit("IN"), F.lit("OUT")), lambda s: F.array_position(parts, s)))
    rows = eml.where(side > 0).select("path", folder_key(F.replace(F.get(parts, (side - 2).cast("int")), F.lit("%20"), F.lit(" "))).alias("voyage_key"), F.lower(F.get(parts, (side - 1).cast("int"))).alias("direction"), "content")
    return rows.mapInPandas(_batches, SCHEMA)
