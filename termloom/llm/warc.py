r"""WARC: a content-addressed archive.

Every distinct payload is stored once under its SHA-256; the exact header bytes of every record are stored
apart. Joining both gives each record back, byte for byte: header, empty line, block, two line ends. The
stored payload is verified on reading: its length, SHA-256 and SHA-1 must equal what the headers say of
the record that was written; a mismatch raises.

Of records with equal payloads of at least ``min_bytes``, that with the largest id is the response and
holds the payload; the others are revisits that refer to it. Smaller payloads are all responses.

Defined results: a null payload is empty; a null URL gives an empty target; repeated ids with equal
payloads: each is a response if it holds the largest id; a null id has no number in its header and is a response only
where all ids of its payload are null; an empty table gives an empty archive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit hexadecimal digest: each five hex digits are four letters."""
    letters = []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


#: The date of records whose pages tell none.
NO_DATE = "1970-01-01T00:00:00Z"


def write_archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both stored: headers (record_id, sha256, header) and payloads (sha256, payload).

    date_col: a timestamp of each page; without one, or null, the date is ``NO_DATE``."""
    date = F.coalesce(F.date_format(F.to_utc_timestamp(pages[date_col], F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_DATE)) if date_col else F.lit(NO_DATE)
    payload = F.encode(F.coalesce(pages[payload_col], F.lit("")), "UTF-8")
    p = pages.select(pages[id_col].cast("long").alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), date.alias("date"), payload.alias("payload"))
    facts = p.select("id", "url", "date", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    # Copies are combined before the one shuffle of payloads.
    payloads = stored(p.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.max("id").alias("holder"), F.first("payload").alias("payload")), "warc-payloads")
    facts = facts.join(payloads.select("sha256", "holder"), "sha256").withColumn("is_response", (F.col("bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("holder")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("is_response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", ident(F.col("id"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(F.col("is_response"), F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", ident(F.col("holder"))))),
        line("Content-Type", F.lit("text/html")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Length", F.when(F.col("is_response"), F.col("bytes")).otherwise(0).cast("string")),
    )
    headers = stored(facts.select(F.col("id").alias("record_id"), "sha256", header.alias("header")), "warc-headers")
    payloads = payloads.select("sha256", "payload")
    return headers, payloads


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per record: record_id, header, the full payload (verified), fields that the header holds."""
    # Each stored payload is measured once, below the join; only what a caller selects goes through it.
    measured = payloads.select("sha256", "payload", F.sha2("payload", 256).alias("_sha256"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    df = headers.join(measured, "sha256", "left")
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    df = df.withColumns({"record_type": field("WARC-Type"), "refers": F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]*)>", 1)})
    sound = (F.col("_sha256") == F.col("sha256")) & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == field("WARC-Payload-Digest")) & (F.col("payload_bytes").cast("string") == field("X-Payload-Length"))
    df = df.withColumn("payload_digest", F.when(F.coalesce(sound, F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its record"))))
    return df.select("record_id", "header", "payload", "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The records with the exact bytes of each as it stands in a WARC file, in place of header and payload."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(b"\r\n")
    return records.withColumn("record", F.concat(F.encode("header", "UTF-8"), end, block, end, end)).drop("header", "payload")
