"""Personal data in texts (DataFrame functions only): patterns propose, checksums confirm, context adjusts.

For each kind a regular expression proposes leftmost non-overlapping spans. Validators confirm them: octets
of an address, Luhn for cards, mod 97 for bank accounts (IBAN), digit counts for phone numbers. Every span has
a score: a base for its kind, raised if a word that goes with the kind stands within CONTEXT code points before
it. The four base kinds are always reported. The method adds bank accounts that pass mod 97, and national phone
numbers, which have no country code and pass only with the help of a context word (score of THRESHOLD or more)
and where they touch no base span.

The patterns are written with possessive quantifiers and look-behind such that they find what the plain forms
in PLAIN find, but in linear time and without recursion on very long texts. Offsets are code points: text is
split at the matches, and the lengths of gaps and matches are added up.

Defined results: null and empty texts have no spans (counts 0, empty strings); repeated rows are treated alike;
an empty table gives no rows; null doc_id is passed through; all columns of the input are kept, and if one of them is
named pii, the spans are in pii_2 (or the next free name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import free_name

#: The base kinds in the order of listing, as the contract writes them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "national": r"(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}",
}
BASE = ("email", "ip", "card", "phone")
#: The same matches in linear time: \G or a look-behind allows a start only where a run begins.
FAST = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
}
#: A cheap condition without which there is no valid span of the kind.
GUARD = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{9}", "national": r"[0-9)][ .-]?[0-9]{3,4}[ .-]?[0-9]{3}"}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
SCORE = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.6, "national": 0.3}
BOOST, THRESHOLD, CONTEXT = 0.25, 0.5, 40
WORDS = {
    "email": "mail|email|contact",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national": "phone|tel|call|mobile|fax|telefon",
}


def _mod97(s: Column) -> Column:
    """Whether an IBAN's check digits hold: letters count as two digits, the first four characters go last."""
    flat = F.translate(s, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.length(flat).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(OCTETS),
    "card": lambda m: F.length(F.translate(m, " -", "")).between(12, 19) & F.call_function("luhn_check", F.translate(m, " -", "")),
    "phone": lambda m: F.length(F.translate(m, "+ ().-", "")).between(9, 15),
    "iban": _mod97,
    "national": lambda m: F.length(F.translate(m, " ().-", "")).between(9, 12),
}
SPAN = "array<struct<start:bigint,stop:bigint,score:double>>"


def _chunks(items: Column) -> Column:
    """A list in slices of about the square root of its size. What appends to a list copies it, so it appends to the list of
    one slice only, and the slices are put together at the end."""
    n = F.size(items)
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))
    return F.when(n > 0, parts).otherwise(F.array())


def _pairs(text: Column, kind: str) -> Column:
    """Matches of a kind's pattern, each with the gap before it, in slices."""
    pattern = FAST[kind]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    guard = F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else text.rlike(GUARD[kind])
    return F.when(guard, F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))))


def _spans(parts: Column, kind: str) -> Column:
    """Valid spans of one kind, in order, from slices of pairs: where each slice begins first, then the spans within it."""
    none, zero = F.array().cast(SPAN), F.lit(0).cast("long")

    def past(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), F.right(F.concat(acc["tail"], x["g"], x["m"]), F.lit(CONTEXT)).alias("tail"))

    def begin(acc: Column, part: Column) -> Column:
        now = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"))
        end = F.aggregate(part, now, past)
        return F.struct(end["at"].alias("at"), end["tail"].alias("tail"), F.concat(acc["heads"], F.array(now)).alias("heads"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], x["g"]), F.lit(CONTEXT))  # each gap is read once, the text never again
        score = F.lit(SCORE[kind]) + F.when(F.lower(before).rlike(rf"(^|[^a-z])({WORDS[kind]})"), BOOST).otherwise(0.0)
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), score.alias("score")))
        tail = F.right(F.concat(before, x["m"]), F.lit(CONTEXT))
        return F.struct(stop.alias("at"), tail.alias("tail"), F.when(VALID[kind](x["m"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    heads = F.aggregate(parts, F.struct(zero.alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:bigint,tail:string>>").alias("heads")), begin, lambda acc: acc["heads"])
    within = F.zip_with(parts, heads, lambda part, h: F.aggregate(part, F.struct(h["at"].alias("at"), h["tail"].alias("tail"), none.alias("found")), step, lambda acc: acc["found"]))
    return F.coalesce(F.flatten(within), none)


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """row (all of docs), text and pii: no column of docs can clash with ours."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    # a column each, so that no pattern runs twice
    out = out.withColumns({kind: _pairs(text, kind) for kind in PLAIN})
    out = out.withColumns({kind: F.when(F.size(kind) > 0, _chunks(F.col(kind))) for kind in PLAIN})
    out = out.withColumns({kind: _spans(F.col(kind), kind) for kind in PLAIN})
    out = out.withColumn("base", F.concat(*BASE))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    own = F.filter("national", lambda s: (s["score"] >= THRESHOLD) & free(s) & ~F.substring(text, s["start"].cast("int"), F.when(s["start"] > 0, 1).otherwise(0)).rlike("[0-9+]"))
    out = out.withColumn("national", F.when(F.size("national") > 0, own).otherwise(F.col("national")))

    def named(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["score"].alias("score")))

    every = F.array_sort(F.concat(*[named(i, kind) for i, kind in enumerate(PLAIN)]))
    spans = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["score"].alias("score")))
    return out.select("row", "text", spans.alias("pii"))


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an array `pii` (or the next free name) of structs (kind, start, stop, score), in order of start, then kind as listed."""
    return _found(docs, text_col).select("row.*", F.col("pii").alias(free_name(docs, "pii")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in square brackets; of overlapping spans the first is named."""
    text, zero = F.col("text"), F.lit(0).cast("long")

    def begin(acc: Column, part: Column) -> Column:
        end = F.aggregate(part, acc["at"], lambda at, s: F.greatest(at, s["stop"]))
        return F.struct(end.alias("at"), F.concat(acc["heads"], F.array(acc["at"])).alias("heads"))

    def pieces(part: Column, at: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(own, (acc["at"] - at).cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
            new = F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(F.concat(gap, F.lit("["), s["kind"], F.lit("]")))).alias("out"))
            return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])

    d = _found(docs, text_col).withColumn("parts", F.when(F.size("pii") > 0, _chunks(F.col("pii"))))
    d = d.withColumn("heads", F.aggregate("parts", F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("heads")), begin, lambda acc: F.concat(acc["heads"], F.array(acc["at"]))))
    # each slice of spans works on its own piece of the text
    slices = F.transform("parts", lambda part, i: F.struct(part.alias("part"), F.col("heads")[i].alias("at"), F.substring(text, F.col("heads")[i].cast("int") + 1, (F.col("heads")[i + 1] - F.col("heads")[i]).cast("int")).alias("own")))
    d = d.withColumn("slices", slices)
    rest = F.substring(text, F.element_at("heads", -1).cast("int") + 1, F.length(text))
    clean = F.when(F.size("pii") > 0, F.concat(F.array_join(F.flatten(F.transform("slices", lambda x: pieces(x["part"], x["at"], x["own"]))), ""), rest)).otherwise(F.col(f"row.`{text_col}`"))
    return d.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op3(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(*BASE))), 256)
    return found.select("doc_id", *[count(kind) for kind in BASE], base.alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def _kind_sql(kind: str) -> str:
    """DuckDB list of (start, rank, stop, kind, score) of one kind's valid spans."""
    p, rank = PLAIN[kind], list(PLAIN).index(kind)
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE (2 * reverse({digits})[i]::INT) // 10 + (2 * reverse({digits})[i]::INT) % 10 END)) % 10 = 0)"
    flat = "replace(m, ' ', '')"
    turned = f"string_split(substr({flat}, 5) || substr({flat}, 1, 4), '')"
    mod97 = f"list_reduce(list_prepend(0::INT, list_transform({turned}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda a, d: (a * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97)"
    valid = {
        "email": "true", "ip": f"regexp_matches(m, '{OCTETS}')", "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({flat}) BETWEEN 15 AND 34 AND {mod97} = 1", "national": f"length({digits}) BETWEEN 9 AND 12",
    }[kind]
    return f"""
    SELECT doc_id, row, start, {rank} AS rank, start + length(m) AS stop, '{kind}' AS kind,
           {SCORE[kind]} + CASE WHEN regexp_matches(lower(substr(t, greatest(start - {CONTEXT}, 0) + 1, least(start, {CONTEXT}))), '(^|[^a-z])({WORDS[kind]})') THEN {BOOST} ELSE 0 END AS score, t
    FROM (
      SELECT doc_id, row, t, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, row, t, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM texts)))
    WHERE {valid}"""


OP3_SQL = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_kind_sql(kind) for kind in BASE)}),
national AS ({_kind_sql("national")}),
iban AS ({_kind_sql("iban")}),
every AS (
  SELECT * FROM base UNION ALL SELECT * FROM iban
  UNION ALL
  SELECT * FROM national s WHERE score >= {THRESHOLD} AND NOT (start > 0 AND regexp_matches(substr(t, start, 1), '[0-9+]'))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = s.row AND b.start < s.stop AND s.start < b.stop)),
lists AS (
  SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4), '') AS base,
         {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)}
  FROM every GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN lists USING (row)
"""
