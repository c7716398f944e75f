"""WARC derivatives: responses become metadata and plain-text conversion records that refer to them.

A record is a row: ``record_id``, ``record_type``, ``target_uri``, ``date``, ``content_type``, ``headers`` (further
named fields) and ``block`` (its bytes). Of each response the builder makes two records. The conversion holds the text
of the page. The metadata holds fields about the page and its outlinks. Both carry ``WARC-Refers-To`` with the
response's id, the target, digests of their own block and of the response's payload, and the response's headers, as
``Source-`` fields in the metadata. Ids follow from the source's id and the kind of record, so a second run, or a task
that runs again after a lost executor, gives the same records.
"""

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, MapType, StringType, StructField, StructType

from trustdesk.llm.common import column, parts_of, utf8

TEXT = StringType()
RECORD = StructType([StructField(n, TEXT) for n in ("record_id", "record_type", "target_uri", "date", "content_type")]
                    + [StructField("headers", MapType(TEXT, TEXT)), StructField("block", BinaryType())])
#: Version line, ends of a line and of a record, and the named fields used here.
VERSION, LINE, END = "WARC/1.1", "\r\n", "\r\n\r\n"
REFERS, BLOCK_DIGEST, PAYLOAD_DIGEST = "WARC-Refers-To", "WARC-Block-Digest", "WARC-Payload-Digest"
#: Space of the ids of derived records.
IDS = uuid.UUID("00000000-0000-5000-8000-000000000000")
BLOCKS = ("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption "
          "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table "
          "tbody td textarea tfoot th thead title tr ul").split()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{kind} {source}')}>"


def page_text(page: str) -> str:
    """Text of a page: what scripts, styles, templates and comments hold goes, block tags end a line, references are
    resolved, white space runs become one space and empty lines go."""
    page = re.sub(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", " ", page)
    page = re.sub(r"\s+", " ", page)
    page = re.sub(rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n", page)
    page = html.unescape(re.sub(r"<[/!?a-zA-Z][^>]*>", "", page))
    lines = (" ".join(x.split()) for x in page.split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str, base: str) -> list:
    """Targets of the page's anchors in order, each once, resolved against its address."""
    found = re.findall(r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", page)
    out = {}
    for target in (html.unescape("".join(x)).strip() for x in found):
        try:
            out[urljoin(base, target)] = None
        except ValueError:
            out[target] = None
    return [x for x in out if x]


def payload_of(block: bytes):
    """Status line and headers of an HTTP response, and its payload; a block without headers is all payload."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [tuple(x.strip() for x in h.partition(":")[::2]) for h in rest], body


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def derive_one(record_id, uri, date, headers, block):
    """The conversion and the metadata record of one response."""
    status, fields, payload = payload_of(block)
    named = {k.lower(): v for k, v in fields}
    charset = re.search(r"charset=[\"']?([\w.:-]+)", named.get("content-type", ""))
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source = digest(payload)
    body = page_text(page).encode()
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title", page)
    about = [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    about += [("source-date", date or ""), ("source-payload-digest", source), ("source-payload-length", str(len(payload)))]
    about += [("source-status", status)] if status else []
    about += [(f"source-http-{k.lower()}", v) for k, v in fields]
    about += [(f"source-{k.lower()}", v) for k, v in sorted((headers or {}).items())]
    about += [("outlink", x) for x in links(page, uri or "")]
    facts = "".join(f"{k}: {one_line(v)}{LINE}" for k, v in about).encode()
    out = []
    for kind, mime, data in (("conversion", "text/plain; charset=utf-8", body), ("metadata", "application/warc-fields", facts)):
        more = {BLOCK_DIGEST: digest(data), "WARC-Source-Payload-Digest": source}
        more |= {REFERS: record_id} if record_id else {}
        more |= {"WARC-Refers-To-Target-URI": one_line(uri)} if uri else {}
        more |= {"WARC-Refers-To-Date": date} if date else {}
        if kind == "conversion":
            more[PAYLOAD_DIGEST] = more[BLOCK_DIGEST]
        out.append((derived_id(record_id or f"{uri} {source}", kind), kind, uri, date, mime, more, data))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Conversion and metadata records of the responses among ``records``; other records give none.

    A null block is an empty page; a response without an id gets ids from its address and payload and refers to
    nothing. Repeated responses give repeated records. Further columns are ignored. One pass, no shuffle.
    """
    responses = records.where("record_type = 'response'").select(
        "record_id", "target_uri", "date", "headers", F.coalesce("block", F.lit(b"")).alias("block"))

    def run(batches):
        for part in parts_of(batches):
            yield to_batch([r for x in part.to_pylist() for r in derive_one(
                x["record_id"], x["target_uri"], x["date"], dict(x["headers"] or ()), x["block"])])

    return responses.mapInArrow(run, RECORD)


def to_batch(rows):
    types = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    columns = [[list(m.items()) if isinstance(m, dict) else m for m in c] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=RECORD.names)


def responses(pages: DataFrame, date: str, page_id="page_id", url="url", body="html") -> DataFrame:
    """Response records of stored pages, each an HTTP block around its html; a null html is empty.

    The id follows from page id, url and html, so equal rows are one response that occurs twice.
    """
    payload = utf8(body)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.length(payload).cast("string"), F.lit("\r\n\r\n"))
    seed = F.md5(F.concat(F.coalesce(column(page_id).cast("string"), F.lit("")), F.lit("\n"),
                          F.coalesce(column(url), F.lit("")), F.lit("\n"), F.md5(payload)))
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(seed, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"),
                    F.lit(">"))
    return pages.select(name.alias("record_id"), F.lit("response").alias("record_type"), column(url).alias("target_uri"),
                        F.lit(date).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"),
                        F.create_map(F.lit("WARC-Identified-Payload-Type"), F.lit("text/html")).alias("headers"),
                        F.concat(head.cast("binary"), payload).alias("block"))


def serialised(record_id, kind, uri, date, mime, headers, block) -> bytes:
    """A record as it stands in a file, without the two line ends behind it."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("Content-Type", mime), *sorted((headers or {}).items()), ("Content-Length", str(len(block)))]
    head = LINE.join([VERSION, *[f"{k}: {one_line(v)}" for k, v in fields if v is not None]])
    return head.encode() + END.encode() + block


def write(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one a partition, through Spark's text writer, whose line end is that of a record."""
    def run(batches):
        for batch in batches:
            out = [serialised(*[r[n] for n in RECORD.names[:5]], dict(r["headers"] or ()), r["block"] or b"")
                   for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = records.select(RECORD.names).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``, cut by their content lengths; a task holds one file at a time."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                data, at, out = data.as_py(), 0, []
                while at < len(data):
                    gap = data.index(END.encode(), at)
                    lines = data[at:gap].decode().split(LINE)
                    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                    size = int(fields.pop("Content-Length"))
                    own = [fields.pop(n, None) for n in ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date",
                                                         "Content-Type")]
                    out.append((*own, fields, data[gap + 4:gap + 4 + size]))
                    at = gap + 8 + size
                if out:
                    yield to_batch(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
