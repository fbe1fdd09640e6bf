"""Extractors whose results carry byte offsets: amounts, counts, dates, organisations.

Offsets of matches are beyond what native regular expression functions give, so
these run over Arrow batches; the patterns are compiled once a process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..dictionaries import AMOUNT, CURRENCIES, MONTHS, NO_COUNT, ORGANISATION_SUFFIXES, ORGANISATIONS, SCALES

LEAST_BYTES = 40
_AMOUNT = re.compile(AMOUNT, re.I)
_COUNT = re.compile(r"\b([0-9][0-9,]*)\s+([A-Za-z]{3,})\b")
_ISO = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b")
_NAMES = "|".join(MONTHS)
_DAY_MONTH = re.compile(rf"\b(\d{{1,2}})\s+({_NAMES})[a-z]*\.?\s+(\d{{4}})\b", re.I)
_MONTH_DAY = re.compile(rf"\b({_NAMES})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", re.I)
_ORGANISATION = re.compile(r"\b([A-Z][A-Za-z&.]*(?:\s+(?:&\s+)?[A-Z][A-Za-z&.]*){0,5}\s+(?:" + "|".join(ORGANISATION_SUFFIXES) + r"))\b\.?")
_KNOWN = [(re.compile(rf"(?<![A-Za-z0-9_]){re.escape(s.lower())}(?![A-Za-z0-9_])"), name) for s, name in ORGANISATIONS]


def _bytes(text: str, at: int) -> int:
    return at if text.isascii() else len(text[:at].encode())


def amounts(text: str) -> list[tuple[float, str, str, str, int]]:
    """value, currency, unit, object, offset of numbers with a currency or a scale.

    A currency needs no word border on its left, so "members 5" is an amount.
    """
    out = []
    for m in _AMOUNT.finditer(text):
        currency, scale = (m[1] or "").lower().rstrip("."), (m[3] or "").lower()
        if currency or scale:
            factor = SCALES.get(scale, SCALES.get(scale.rstrip("s"), 1.0)) if scale else 1.0
            out.append((float(m[2].replace(",", "")) * factor, CURRENCIES.get(currency, ""), scale, "", _bytes(text, m.start())))
    return out


def counts(text: str) -> list[tuple[str, float, str, int]]:
    """count_type, number, object, offset of numbers before a plural noun."""
    return [("", float(m[1].replace(",", "")), noun, _bytes(text, m.start())) for m in _COUNT.finditer(text) if (noun := m[2].lower()).endswith("s") and noun not in NO_COUNT]


def dates(text: str) -> list[tuple[str, int, int, int, int]]:
    """resolution, year, month, day, offset; ISO dates first, then day-month and month-day ones.  The calendar isn't consulted."""
    month = lambda s: MONTHS.index(s[:3].lower()) + 1
    return (
        [("day", int(m[1]), int(m[2]), int(m[3]), _bytes(text, m.start())) for m in _ISO.finditer(text)]
        + [("day", int(m[3]), month(m[2]), int(m[1]), _bytes(text, m.start())) for m in _DAY_MONTH.finditer(text)]
        + [("day", int(m[3]), month(m[1]), int(m[2]), _bytes(text, m.start())) for m in _MONTH_DAY.finditer(text)]
    )


def norm_name(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def organisations(text: str) -> list[tuple[str, str, int, float, str | None]]:
    """surface_form, entity_type, offset, salience, entity_id; known names and capitalised names with a company suffix, by offset then name."""
    found: dict[str, list] = {}

    def add(surface: str, at: int) -> None:
        entry = found.setdefault(norm_name(surface), [surface, at, 0])
        entry[1], entry[2] = min(entry[1], at), entry[2] + 1

    lower = text.lower()
    for pattern, name in _KNOWN:
        for m in pattern.finditer(lower):
            add(name, _bytes(lower, m.start()))
    for m in _ORGANISATION.finditer(text):
        add(m[1].strip().rstrip("."), _bytes(text, m.start()))
    most = max((n for _, _, n in found.values()), default=1)
    return sorted(((s, "ORG", at, n / most, None) for s, at, n in found.values()), key=lambda x: (x[2], x[0]))


#: Result type of each extractor.
EXTRACTORS = {
    "amounts": (amounts, "array<struct<value:double,currency:string,unit:string,object:string,char_offset:bigint>>", pa.list_(pa.struct([("value", pa.float64()), ("currency", pa.string()), ("unit", pa.string()), ("object", pa.string()), ("char_offset", pa.int64())]))),
    "counts": (counts, "array<struct<count_type:string,number:double,object:string,char_offset:bigint>>", pa.list_(pa.struct([("count_type", pa.string()), ("number", pa.float64()), ("object", pa.string()), ("char_offset", pa.int64())]))),
    "dates_referenced": (dates, "array<struct<resolution:string,year:int,month:int,day:int,char_offset:bigint>>", pa.list_(pa.struct([("resolution", pa.string()), ("year", pa.int32()), ("month", pa.int32()), ("day", pa.int32()), ("char_offset", pa.int64())]))),
    "organizations": (organisations, "array<struct<surface_form:string,entity_type:string,char_offset:bigint,salience:double,entity_id:string>>", pa.list_(pa.struct([("surface_form", pa.string()), ("entity_type", pa.string()), ("char_offset", pa.int64()), ("salience", pa.float64()), ("entity_id", pa.string())]))),
}


def with_extracts(df: DataFrame, kinds: list[str], text: str = "text") -> DataFrame:
    """Add a column for each extractor; null texts and those under 40 bytes have empty lists."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and len(t.encode()) >= LEAST_BYTES else "" for t in batch.column(names.index(text)).to_pylist()]
            new = []
            for k in kinds:
                extract, _, kind = EXTRACTORS[k]
                keys = [f.name for f in kind.value_type]
                new.append(pa.array([[dict(zip(keys, x, strict=True)) for x in extract(t)] for t in texts], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *kinds])

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{k}` {EXTRACTORS[k][1]}" for k in kinds])
    return df.mapInArrow(run, schema)
