"""Mail text to rows. A mail's head is a walk over its first lines and its trade one of a few patterns: small functions over
Arrow batches, about fifteen times as fast as the same as folds of native expressions, which no code is generated for."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparrowlog.functions.arrays import as_structs
from sparrowlog.functions.latest import epoch_clock
from sparrowlog.functions.text import SPACE
from sparrowlog.operators.ingest import text_hash

HEADER_LINES, LARGEST = 8, 10**15
# Formats of trade mails, tried in this order, and the order of their groups.
CREDITS = r"([\d,]+)\s+credits?"
SALES = [
    ("vendor", rf"Vendor:\s*(.+?)\s+has sold\s+(.+?)\s+to\s+(.+?)\s+for\s+{CREDITS}", (1, 2, 3, 4)),
    ("vendor", rf"Your vendor\s+(.+?)\s+has sold\s+(.+?)\s+to\s+(.+?)\s+for\s+{CREDITS}", (1, 2, 3, 4)),
    ("bazaar", rf"Your auction of\s+(.+?)\s+has been sold to\s+(.+?)\s+for\s+{CREDITS}", (None, 1, 2, 3)),
]
PURCHASES = [
    ("bazaar", rf"You (?:have )?won the auction of\s+(.+?)\s+from\s+(.+?)\s+for\s+{CREDITS}"),
    ("vendor", rf"You (?:have )?purchased\s+(.+?)\s+from\s+(?:the )?(?:[Vv]endor:?\s+)?(.+?)\s+for\s+{CREDITS}"),
]


LINE = re.compile(r"([A-Za-z]+):\s?(.*)", re.S)
ID, BARE_STAMP, ID_STAMP = re.compile(r"[0-9]+(_[0-9]+)?"), re.compile(r"[0-9]{9,13}"), re.compile(r"_([0-9]{9,13})$")
HEAD = StructType([StructField("mail_id", StringType()), StructField("sender", StringType()), StructField("subject", StringType()), StructField("stamp", LongType()), StructField("body", StringType())])
SALE = StructType([StructField("item_name", StringType()), StructField("buyer", StringType()), StructField("credits", LongType()), StructField("vendor", StringType()), StructField("sale_type", StringType())])
PURCHASE = StructType([StructField("item_name", StringType()), StructField("seller", StringType()), StructField("credits", LongType()), StructField("purchase_type", StringType())])


def clock(text: str) -> int | None:
    """A stamp of digits as a number, nothing if it is none or out of range."""
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 and 0 < int(text) < 10**16 else None


def read_mail(raw: str | None) -> tuple[str, str, str, int | None, str]:
    """(mail_id, sender, subject, stamp, body). The first line may be the id; then come up to eight lines with or without names;
    a blank line after any of them ends the head."""
    lines = (raw or "").replace("\r\n", "\n").split("\n")
    mail_id = sender = subject = ""
    stamp, body, unnamed = None, 0, 0
    for i, line in enumerate(lines[:HEADER_LINES]):
        text = line.strip(SPACE)
        named = LINE.fullmatch(line) if ":" in line else None
        name = named[1].upper() if named else ""
        if i == 0 and ID.fullmatch(text):
            mail_id = text
        elif name == "FROM":
            sender = named[2].strip(SPACE)
        elif name == "SUBJECT":
            subject = named[2].strip(SPACE)
        elif name == "TIMESTAMP":
            stamp = clock(named[2].strip(SPACE)) if stamp is None else stamp
        elif stamp is None and i and (sender or subject) and BARE_STAMP.fullmatch(text):
            stamp = clock(text)
        elif not text and body:
            body = i + 1
            break
        elif stamp is None and unnamed < 2 and text:
            if not unnamed and not sender:
                sender = text
            elif not subject:
                subject = text
            unnamed += 1
        elif body:
            break
        else:
            continue
        body = i + 1
    if stamp is None and (found := ID_STAMP.search(mail_id)):
        stamp = clock(found[1])
    return mail_id, sender, subject, stamp, "\n".join(lines[body:]).strip(SPACE)


def number(text: Column) -> Column:
    """Digits with commas as a number: 0 where there is no digit, no more than ``LARGEST`` so that sums stay in range."""
    digits = F.replace(text, F.lit(","), F.lit(""))
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(F.coalesce(F.least(digits.try_cast("long"), F.lit(LARGEST)), F.when(digits.rlike(r"^\d+$"), F.lit(LARGEST))))


def credits_of(text: str) -> int:
    """The same of one text."""
    digits = text.replace(",", "")
    return min(int(digits), LARGEST) if 0 < len(digits) < 4000 else LARGEST if digits else 0


def tidy(name: str) -> str:
    """``clean_name`` of one text."""
    name = name.strip(SPACE)
    name = name[1:] if name.startswith("[") else name
    name = name[:-1] if name.endswith("]") else name
    return re.sub(r"\s+", " ", name).rstrip(".")


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\d", "0-9"), re.I)


def sale_of(subject: str | None, body: str | None) -> tuple | None:
    text = f"{subject or ''}\n{body or ''}"
    if "sold" not in text.lower():
        return None
    for kind, pattern, (vendor, item, buyer, credits) in SALE_RULES:
        if m := pattern.search(text):
            return tidy(m[item]), tidy(m[buyer]), credits_of(m[credits]), tidy(m[vendor]) if vendor else "", kind
    return None


def purchase_of(subject: str | None, body: str | None) -> tuple | None:
    text = f"{subject or ''}\n{body or ''}"
    low = text.lower()
    for word, kind, pattern in PURCHASE_RULES:
        if word in low and (m := pattern.search(text)):
            return tidy(m[1]), tidy(m[2]), credits_of(m[3]), kind
    return None


SALE_RULES = [(kind, compiled(pattern), places) for kind, pattern, places in SALES]
PURCHASE_RULES = [("auction" if kind == "bazaar" else "purchased", kind, compiled(pattern)) for kind, pattern in PURCHASES]


@F.arrow_udf(SALE)
def sale(subject: pa.Array, body: pa.Array) -> pa.Array:
    """What a parsed mail says was sold, null if it is no sale."""
    return as_structs(list(map(sale_of, subject.to_pylist(), body.to_pylist())), SALE)


@F.arrow_udf(PURCHASE)
def purchase(subject: pa.Array, body: pa.Array) -> pa.Array:
    """What a parsed mail says was bought, null if it is no purchase."""
    return as_structs(list(map(purchase_of, subject.to_pylist(), body.to_pylist())), PURCHASE)


#: A trade of each kind: its function, its fields, and what a mail with one has in any case.
TRADES = {"sale": (sale_of, SALE, "(?i)sold"), "purchase": (purchase_of, PURCHASE, "(?i)auction|purchased")}


@cache
def reader(*kinds: str):
    """Head and trades of a mail in one call, so that a task has one Python worker. It counts as nondeterministic, as a filter on
    its result would else be pushed below it with a second call of its own."""

    def read(raw: pa.Array) -> pa.Array:
        heads = list(map(read_mail, raw.to_pylist()))
        found = [as_structs([of(h[2], h[4]) for h in heads], fields) for of, fields, _ in map(TRADES.get, kinds)]
        return pa.StructArray.from_arrays([*as_structs(heads, HEAD).flatten(), *found], [*HEAD.names, *kinds])

    return F.arrow_udf(read, StructType([*HEAD.fields, *[StructField(k, TRADES[k][1]) for k in kinds]])).asNondeterministic()


def parse_mails(mails: DataFrame, *kinds: str) -> DataFrame:
    """Adds fingerprint, mail_id, sender, subject, sent_at and body to rows of (raw, ...), and trades of the kinds given."""
    rows = mails.select("*", reader(*kinds)(F.col("raw")).alias("_head"))
    names = ["mail_id", "sender", "subject", "body", *kinds]
    return rows.select(*mails.columns, *[F.col(f"_head.{c}") for c in names], text_hash(F.col("raw")).alias("fingerprint"), epoch_clock(F.col("_head.stamp")).alias("sent_at"))


def trades(mails: DataFrame, kind: str) -> DataFrame:
    """Parsed mails with a trade of the kind. What lacks the words of such a trade is not walked."""
    return parse_mails(mails.filter(F.col("raw").rlike(TRADES[kind][2])), kind).filter(F.col(kind).isNotNull())


def with_trades(mails: DataFrame, *kinds: str) -> DataFrame:
    """Parsed mails with their ``sale`` and ``purchase``, or one of them."""
    wanted = [(kind, value) for kind, value in (("sale", sale), ("purchase", purchase)) if not kinds or kind in kinds]
    return mails.select("*", *[value("subject", "body").alias(kind) for kind, value in wanted])


def upload(archive: DataFrame, mails: DataFrame, as_of) -> DataFrame:
    """Newly archived mails of (user_id, raw) with their trades; mails that the archive (user_id, fingerprint) has are left out. Mails and
    archive are grouped by user and hash together, so that a text is shuffled once, beside the 32 bytes of its hash. Keys without a
    value are in no archive."""
    rest = [c for c in mails.columns if c != "user_id"]
    new = mails.select("user_id", F.unhex(text_hash(F.col("raw"))).alias("_hash"), F.struct(*rest).alias("_mail"), F.lit(False).alias("_known"))
    none = F.lit(None).cast(new.schema["_mail"].dataType)
    known = F.col("user_id").isNotNull() & F.coalesce(F.col("fingerprint").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))
    old = archive.select("user_id", F.unhex("fingerprint").alias("_hash"), none.alias("_mail"), known.alias("_known"))
    groups = new.unionByName(old).groupBy("user_id", "_hash").agg(F.first("_mail", ignorenulls=True).alias("_mail"), F.bool_or("_known").alias("_known"))
    rows = groups.filter(F.col("_mail").isNotNull() & ~F.col("_known")).select(*[F.col(f"_mail.{c}") if c in rest else F.col(c) for c in mails.columns])
    return parse_mails(rows, "sale", "purchase").withColumn("occurred_at", F.coalesce("sent_at", F.lit(as_of).cast("timestamp")))
