"""Scalar functions as Columns (F1, F2, F7-F31, P1, P5-P7 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def normalize_token(x: Column) -> Column:
    """lower case, only digits, a-z and Hangul syllables."""
    return F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]+", "")


def normalize_words(x: Column) -> Column:
    """lower-case words of digits, a-z and Hangul, one space apart."""
    return F.trim(F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]+", " "))


def is_placeholder(x: Column) -> Column:
    """Whether a cell holds one of the values that stand for none."""
    return F.lower(F.trim(x)).isin(*C.PLACEHOLDERS_CELL)


def resolved_cell_value(text: Column) -> Column:
    """The value after the last "Cell Value:" of a serialized cell, null for placeholders."""
    value = F.trim(F.regexp_extract(text, r"Cell Value: *([^|\n]*)$", 1))
    return F.when(~is_placeholder(value), value)


def literal_contains(x: Column, needle: str) -> Column:
    """Case-insensitive substring, % and _ of the needle taken literally."""
    return F.lower(x).contains(needle.lower())


def guarded_int(x: Column) -> Column:
    """P5: an integer if the text is digits only, else null."""
    return F.when(x.rlike(r"^\d+$"), x.try_cast("int"))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as the SQL rounds doubles: half away from zero of the scaled double, not of its shortest decimal text."""
    return F.round(x * 10.0**digits) / 10.0**digits


def benchmark_score(x: Column, floor: float, ceiling: float) -> Column:
    """F16: position between two bounds on a scale of 100, rounded to 2 digits."""
    return rounded(clamp((x - floor) / (ceiling - floor) * 100.0), 2)


def growth_score(percent: Column) -> Column:
    return benchmark_score(percent, C.GROWTH_FLOOR, C.GROWTH_CEILING)


def profitability_score(percent: Column) -> Column:
    return benchmark_score(percent, C.MARGIN_FLOOR, C.MARGIN_CEILING)


def stability_score(liabilities_to_assets: Column, net_debt: Column, revenue: Column) -> Column:
    """0.7 leverage + 0.3 funding."""
    leverage = clamp((70.0 - liabilities_to_assets) / 40.0 * 100.0)
    ratio = net_debt / F.greatest(revenue, F.lit(1.0)) * 100.0
    funding = F.when(ratio <= 0, 100.0).otherwise(clamp(100.0 - ratio * 4.0))
    return rounded(leverage * 0.70 + funding * 0.30, 2)


def tier(score: Column) -> Column:
    """F18."""
    out = F.lit("C")
    for name, least in reversed(C.TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def trend_class(previous: Column, current: Column, higher_is_better: bool = True) -> Column:
    """null previous is the baseline, null current is na."""
    change = current - previous if higher_is_better else previous - current
    return (
        F.when(current.isNull(), "na")
        .when(previous.isNull(), "baseline")
        .when(change >= C.TREND_STRONG, "strong-improvement")
        .when(change >= C.TREND_WEAK, "improvement")
        .when(change > -C.TREND_WEAK, "stable")
        .when(change > -C.TREND_STRONG, "decline")
        .otherwise("strong-decline")
    )


def percent_change(first: Column, last: Column) -> Column:
    """null if the first value is zero."""
    return F.try_divide(last - first, F.abs(first)) * 100


def year_in_label(label: Column) -> Column:
    """the first year from 1900 to 2199 in a label, else null."""
    found = F.regexp_extract(label, r"(19\d{2}|2[01]\d{2})", 1)
    return F.when(found != "", found).cast("int")


def year_of_digits(label: Column) -> Column:
    """the first four digits of a label, wherever they stand."""
    digits = F.substring(F.regexp_replace(label, "[^0-9]", ""), 1, 4)
    return F.when(F.length(digits) == 4, digits).cast("int")


def column_letters(col: Column) -> Column:
    """letters of a column number, up to three of them."""

    def letter(n: Column) -> Column:
        return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(n - 1, F.lit(26)).cast("int") + 1, F.lit(1))

    second = F.floor((col - 1) / 26)
    third = F.floor((second - 1) / 26)
    return F.concat(F.when(third > 0, letter(third)).otherwise(""), F.when(second > 0, letter(second)).otherwise(""), letter(col))


def row_of_coordinate(coord: Column) -> Column:
    return F.regexp_extract(coord, r"(\d+)$", 1).try_cast("int")


def column_of_coordinate(coord: Column) -> Column:
    """the column number of a coordinate like AB12."""
    letters = F.split(F.regexp_extract(F.upper(coord), r"^([A-Z]+)", 1), "")
    return F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def numbers_in(text: Column) -> Column:
    """numbers of a text, thousands separators dropped, (x) taken as negative."""
    found = F.regexp_extract_all(text, F.lit(r"(\(?-?\d[\d,]*(?:\.\d+)?\)?)"), F.lit(1))

    def value(x):
        n = F.regexp_replace(x, r"[(),]", "").cast("double")
        return F.when(x.startswith("(") & x.endswith(")"), -F.abs(n)).otherwise(n)

    return F.transform(found, value)


def number_matches(actual: Column, expected: Column) -> Column:
    """within half a percent or one hundredth."""
    return F.abs(actual - expected) <= F.greatest(F.lit(0.01), F.abs(expected) * 0.005)


def token_cost(inputs: Column, cached: Column, outputs: Column, rate_in: float, rate_cached: float, rate_out: float, long_from: int = 272_000, long_in: float = 2.0, long_out: float = 1.5) -> Column:
    """cost in dollars at rates for a million tokens; beyond long_from input tokens rates are multiplied."""
    long_ = inputs > long_from
    more_in, more_out = F.when(long_, long_in).otherwise(1.0), F.when(long_, long_out).otherwise(1.0)
    return ((inputs - cached) * rate_in * more_in + cached * rate_cached * more_in + outputs * rate_out * more_out) / 1_000_000


def short_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    """F32: prefix and the first hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def hash_bucket(x: Column, n: int) -> Column:
    """a deterministic bucket from the first 8 hex digits of the SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def cosine(a: Column, b: Column) -> Column:
    """F7 as similarity: cosine of two arrays in double; null if either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def sign_bits(v: Column) -> Column:
    """F8: sign quantization, one bit for each component above zero, packed into longs of 32 bits."""
    words = F.ceil(F.size(v) / 32).cast("int")
    return F.transform(
        F.sequence(F.lit(0), words - 1),
        lambda w: F.aggregate(F.slice(v, w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0)),
    )


def hamming(a: Column, b: Column) -> Column:
    """F8: bits in which two packed vectors differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def workbook_company(file_name: Column) -> Column:
    """the company that a workbook's file name states, null for other names."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    slug = F.regexp_extract(stem, C.WORKBOOK_NAME, 1)
    words = F.filter(F.split(slug, "_"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*C.CAPITAL_WORDS), F.upper(w)).otherwise(F.initcap(w))), " ")
    for own, written in C.OWN_SPELLING.items():
        shown = F.when(F.lower(slug) == own, written).otherwise(shown)
    return F.when(shown != "", shown)


def visualization_card(question: Column) -> Column:
    """the card of the first word list that the question has a word of."""
    out = F.lit("stability")
    for card, words in reversed(C.CARD_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(question).contains(w)
        out = F.when(hit, card).otherwise(out)
    return out


def short_number(value: Column, digits: int = 1) -> Column:
    """a number with commas and at most so many digits after the point, half away from zero, without closing zeros."""
    return F.regexp_replace(F.format_number(F.round(value, digits), digits), r"\.?0+$" if digits > 1 else r"\.0$", "")


def krw_amount(value: Column, axis: bool = False) -> Column:
    """an amount in the largest unit of won that it reaches; an axis leaves out the won."""
    shown = short_number(value)
    for least, unit in reversed(C.WON_UNITS):
        shown = F.when(F.abs(value) >= least, F.concat(short_number(value / least), F.lit(unit))).otherwise(shown)
    return shown if axis else F.concat(shown, F.lit("원"))


def _by_name(x: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(x == name, F.lit(text)).otherwise(out)
    return out


def international_amount(value: Column, currency: Column, scale: Column) -> Column:
    """an amount with the currency's symbol (or its code and a space) before it and the scale's letter behind."""
    symbol = F.coalesce(_by_name(currency, C.CURRENCY_SYMBOLS), F.concat(currency, F.lit(" ")))
    return F.concat(F.when(value < 0, "-").otherwise(""), symbol, short_number(F.abs(value)), F.coalesce(_by_name(scale, C.SCALE_SUFFIXES), F.lit("")))


def signed_percent(value: Column) -> Column:
    """a percentage with its sign, but for zero."""
    shown = F.round(value, 1)
    return F.concat(F.when(shown > 0, "+").otherwise(""), F.when(shown == 0, "0").otherwise(short_number(value)), F.lit("%"))


def comparison_amount(value: Column, currency: Column, scale: Column) -> Column:
    """a whole amount as comparisons show it."""
    symbol = F.coalesce(_by_name(currency, {"USD": "$", "KRW": "₩"}), F.concat(currency, F.lit(" ")))
    return F.concat(F.when(value < 0, "-").otherwise(""), symbol, F.format_number(F.round(F.abs(value), 0), 0), F.coalesce(_by_name(scale, C.SCALE_SUFFIXES), F.lit("")))


def axis_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """bounds of an axis at multiples of the step, from 0 to the usual top unless values lie outside."""
    step = float(C.AXIS_STEP)
    below = F.when(low < 0, F.floor((low - step) / step) * step).otherwise(0.0)
    above = F.when(high > C.AXIS_TOP, F.ceil((high + step) / step) * step).otherwise(float(C.AXIS_TOP))
    return below, above


def similarity(distance: Column, clamped: bool = True) -> Column:
    """one less the distance; clamped (the catalog's search) never below zero."""
    return F.greatest(F.lit(0.0), 1 - distance) if clamped else 1 - distance


def calendar_quarter(day: Column) -> Column:
    """a label like 2025-Q1."""
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def cleaned(*columns: Column) -> Column:
    """The first of the columns that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def same_name(a: Column, b: Column) -> Column:
    """Equality of cleaned texts in any case; two blank ones are no match."""
    return F.coalesce(F.upper(cleaned(a)) == F.upper(cleaned(b)), F.lit(False))


def is_sha256(x: Column) -> Column:
    """64 lower-case hex digits."""
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def live(deleted_at: Column, text: Column) -> Column:
    """Rows that are neither deleted nor blank."""
    return deleted_at.isNull() & cleaned(text).isNotNull()


def json_set(json: Column, key: str, value: Column) -> Column:
    """a JSON object with one key set to a text, the others as they are; null counts as an empty object."""
    entries = F.from_json(F.coalesce(json, F.lit("{}")), "map<string,variant>")
    return F.to_json(F.map_concat(F.map_filter(entries, lambda k, v: k != key), F.create_map(F.lit(key), value.cast("variant"))))


def json_list_size(json: Column) -> Column:
    """length of a JSON array, null for anything else."""
    return F.json_array_length(json)


def name_uuid(namespace: str, name: Column) -> Column:
    """the version 5 UUID of a name: SHA-1 of namespace and name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(part(17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def query_terms(text: Column) -> Column:
    """what a keyword query searches for: row, column and value fields of a serialized cell, without signs.

    Text without such fields is taken whole; where nothing is left the trimmed text stays.
    """
    fields = F.filter(F.split(text, r"\|"), lambda s: F.lower(F.trim(F.split_part(s, F.lit(":"), F.lit(1)))).isin("row header", "column header", "cell value") & s.contains(":"))
    values = F.transform(fields, lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", "")))
    lexical = F.when(F.size(fields) > 0, F.array_join(F.filter(values, lambda v: (v != "") & (v != "?")), " ")).otherwise(text)
    tokens = F.filter(F.split(F.regexp_replace(lexical, r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda t: t != "")
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(F.trim(text))


def serialized_cell(company: Column, sheet: Column, row_headers: Column, column_headers: Column, value: Column) -> Column:
    """the five fields of a cell as one text; what is missing is a question mark."""
    path = lambda h: F.when(F.size(h) > 0, F.array_join(h, " > ")).otherwise("?")
    field = lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("?"))
    named = (("Company", field(company)), ("Sheet", field(sheet)), ("Row Header", path(row_headers)), ("Column Header", path(column_headers)), ("Cell Value", F.coalesce(F.nullif(value, F.lit("")), F.lit("?"))))
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{n}: "), x) for n, x in named))


def parsed_cell(text: Column) -> dict[str, Column]:
    """the five fields of a serialized cell, paths as arrays; null where the text has a question mark."""
    get = lambda n: F.trim(F.regexp_extract(text, rf"(?:^|\| ){n}: ([^|]*)", 1))
    known = lambda x: F.when(~x.isin("", "?"), x)
    out = {c: known(get(n)) for c, n in (("company", "Company"), ("sheet", "Sheet"), ("cell_value", "Cell Value"))}
    return out | {c: F.split(known(get(n)), " > ") for c, n in (("row_headers", "Row Header"), ("column_headers", "Column Header"))}


# Labels that precede account names in older row headers, and legal forms that end a company's name.
LEGACY_PREFIX = r"(?i)^(?:source\s*:|data\s+in\b|fiscal\s+year\s+ended\b|ltm$)"
LEGAL_TITLE = r"(?i)\b(?:corporation|corp\.?|inc\.?|incorporated|limited|ltd\.?|plc|company|co\.?)$"


def account_headers(headers: Column, company: Column) -> Column:
    """a row header path without the company, source, unit and period labels that older documents began it with."""

    def behind_labels(v: Column) -> Column:
        first = F.array_position(F.transform(v, lambda x: ~x.rlike(LEGACY_PREFIX)), True).cast("int")
        return F.when(first > 0, F.slice(v, first, F.size(v))).otherwise(F.slice(v, 1, 0))

    own = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    values = F.filter(F.transform(headers, lambda x: F.trim(x)), lambda x: (x != "") & ((own == "") | (F.lower(x) != own)))
    values = behind_labels(values)
    titled = (F.size(values) > 1) & (F.get(values, F.lit(1)).rlike(LEGACY_PREFIX) | F.get(values, F.lit(0)).rlike(LEGAL_TITLE))
    return F.when(titled, behind_labels(F.slice(values, 2, F.size(values)))).otherwise(values)


# Periods as dates and as fiscal years; currencies and scales in the order in which they are tried.
DATE_TEXT = r"(?<!\d)(20\d{2}|19\d{2})[-./](0?[1-9]|1[0-2])[-./](0?[1-9]|[12]\d|3[01])(?!\d)"
FISCAL_TEXT = r"(?i)\bFY\s*[-_ ]?(20\d{2}|19\d{2})\b|(?<!\d)(20\d{2}|19\d{2})\s*(?:A|FY)\b"
CURRENCIES = (
    (r"(?i)\b(?:u\.?s\.?\s*dollars?|usd)\b", "USD"),
    (r"(?i)\b(?:euros?|eur)\b", "EUR"),
    (r"(?i)\b(?:korean\s+won|krw)\b|원화", "KRW"),
    (r"(?i)\b(?:japanese\s+yen|jpy)\b|엔화", "JPY"),
    (r"(?i)\b(?:british\s+pounds?|pound\s+sterling|gbp)\b", "GBP"),
    (r"(?i)(?:data\s+in|amounts?\s+in)\s*\(\s*\$", "USD"),
    (r"(?i)\$\s*(?:k|m|mm|bn|b)\b", "USD"),
)
SCALES = (
    (r"(?i)\b(?:billions?|bn)\b|\$\s*(?:bn|b)\b", "billions"),
    (r"(?i)\b(?:millions?|mm)\b|\$\s*(?:m|mm)\b", "millions"),
    (r"(?i)\b(?:thousands?|000s)\b|\$\s*k\b|천\s*단위", "thousands"),
    (r"(?i)\bones\b|원\s*단위", "ones"),
)


def first_pattern(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """the name of the first pattern that the text has, else null."""
    return F.coalesce(*(F.when(text.rlike(p), name) for p, name in patterns))


def period_of(text: Column) -> Column:
    """a struct (end_date, year, label) of the first date or fiscal year in a text; null without one.

    A date that is none (February 30) gives null, even beside a fiscal year.
    """
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    part = lambda p, k: F.regexp_extract(text, p, k)
    day = F.try_to_date(F.concat_ws("-", part(DATE_TEXT, 1), F.lpad(part(DATE_TEXT, 2), 2, "0"), F.lpad(part(DATE_TEXT, 3), 2, "0")), "yyyy-MM-dd")
    year = F.concat(part(FISCAL_TEXT, 1), part(FISCAL_TEXT, 2)).try_cast("int")
    make = lambda d, y, label: F.struct(d.alias("end_date"), y.alias("year"), label.alias("label"))
    dated = part(DATE_TEXT, 0) != ""
    return F.when(dated & day.isNotNull(), make(day, F.year(day), part(DATE_TEXT, 0))).when(~dated & year.isNotNull(), make(F.lit(None).cast("date"), year, part(FISCAL_TEXT, 0)))


def suggestion(templates: list[str], companies: list[str], seed: Column, n: int = 3) -> Column:
    """F40 as a Column: n questions of the templates and companies, both rotated by the seed."""
    t, c = F.array(*map(F.lit, templates)), F.array(*map(F.lit, companies))
    a, b = F.pmod(seed, F.lit(len(templates))), F.floor(seed / len(templates)).cast("int")
    at = lambda x, k, size: F.get(x, F.pmod(k, F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.replace(at(t, a + k, len(templates)), F.lit("{company}"), at(c, b + k, len(companies))))


def suggestions(companies: list[str], templates: list[str], seed: int, n: int = 3) -> list[str]:
    """n questions from lists of templates and companies, both rotated by the seed."""
    a, b = seed % len(templates), seed // len(templates)
    return [templates[(a + k) % len(templates)].format(company=companies[(b + k) % len(companies)]) for k in range(n)]
