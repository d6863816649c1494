"""Personal data by DataFrame functions alone: patterns propose, checksums confirm, nearby words adjust the score.

Positions are code points, end exclusive. A pattern's matches are found by regexp_extract_all, and the text between them by
split with the same pattern, so a match begins where the lengths before it end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACED = "struct<start:int,end:int,value:string,before:string,after:string>"
#: Matches whose outputs are gathered at once.
BLOCK = 256
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    """`pattern`: for Java's matcher; `plain`: the same matches without lookbehind or possessive quantifiers, for other engines."""

    name: str
    pattern: str
    plain: str
    score: float
    words: str
    hint: str | None = None  # a literal that every match holds
    needs_words: bool = False
    base: bool = True
    least: int = 2  # code points of the shortest match
    prefixes: bool = False  # the pattern takes a match's beginning and has the longest match as group 1; see `longest`


#: The patterns match what the plain ones match, but account numbers are tried at every beginning. Possessive quantifiers and run starts keep them linear on hostile texts: a
#: run that fails at its first character fails at every later one.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, "mail|contact|write|reply", "@", least=5),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0.6, "ip|host|server|address|client", ".", least=7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", 0.7, "card|visa|credit|debit|pay|mastercard"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "tel|phone|call|mobile|fax|whatsapp", "+", least=4),
    Kind("iban", r"\b(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b))[A-Z]{2}[0-9]{2}", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", 0.8,
         "iban|bank|account|konto|compte|cuenta", base=False, least=4, prefixes=True),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.3, "ssn|social|security", "-", True, False, least=11),
)
#: A part of an address: at most 255, leading zeros allowed.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words count within this many code points on either side and add this much to a score.
NEAR, BONUS, ACCEPT = 40, 0.2, 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn check of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The mod-97 check of an account number: the first four characters go last, letters count from 10, the rest is 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: Kind, value: Column) -> Column:
    n = F.length(digits(value))
    if kind.name == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}\z")
    if kind.name == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    if kind.name == "phone":
        return n.between(10, 15)
    if kind.name == "iban":
        return mod97(value)
    return F.lit(True)


def longest(kind: Kind, value: Column) -> Column:
    """The longest confirmed part of a match from its beginning to a blank or its end; empty if there is none.

    Words after a number can look like more of it, so the whole match failing says nothing of its parts.
    """
    words = F.split(value, " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    fine = F.filter(parts, lambda x: x.rlike(rf"^(?:{kind.plain})\z") & confirmed(kind, x))
    return F.coalesce(F.get(fine, F.lit(0)), F.lit(""))


def folded(items: Column, state: str, first: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """The outputs of a fold over an array: step(state, item) gives the next state, an output, and whether it is kept.

    Appending to an array copies it, so outputs are gathered in blocks of BLOCK items: the work is close to linear in the items,
    however many a text has.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, out, keep = step(acc["state"], x)
        return F.struct(after.alias("state"), F.when(keep, F.concat(acc["out"], F.array(out))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        # Bound once, since both of its parts are used.
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), F.lit(0))

    def run(xs: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        cut = F.transform(places, lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))
        zero = F.struct(first.cast(state).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(xs) > 0, F.aggregate(cut, zero, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return F.get(F.transform(F.array(items), run), F.lit(0))  # binds the items once


def apart(spans: Column) -> Column:
    """The spans (start, end, value, before, after) that aren't empty and begin after the one kept before has ended."""

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        keep = (x["value"] != "") & (x["start"] >= at)
        return F.when(keep, x["end"]).otherwise(at), x, keep

    return folded(spans, "int", F.lit(0), step, PLACED)


def found(text: Column, order: int, kind: Kind) -> Column:
    """array<struct<start, ord, end, kind, score>> of one kind's confirmed matches in a text that isn't null."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.prefixes else 0))
    if kind.hint:
        matches = F.when(text.contains(kind.hint), matches).otherwise(F.array().cast("array<string>"))

    wide = NEAR + 64 if kind.prefixes else NEAR  # a value is 64 code points at most

    def placed(ms: Column, ps: Column) -> Column:
        """The matches with their places, and what stands near them. A match's beginning alone is cut out of the text before it."""
        own = F.transform(F.arrays_zip(F.slice(ps, F.lit(1), F.size(ms)).alias("p"), ms.alias("m")), lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), (F.substr(x["m"], F.lit(1), F.lit(4)) if kind.prefixes else x["m"]).alias("w")))

        def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
            start = at + F.length(x["p"])
            end = start + F.length(x["w"])
            return end, F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")), F.lit(True)

        at = folded(own, "int", F.lit(0), step, "struct<start:int,end:int,value:string>")
        at = F.transform(at, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), i.alias("i")))
        if not kind.prefixes:
            at = F.filter(at, lambda x: confirmed(kind, x["value"]))
        # Only the ends of the pieces around a match are read, so its surroundings cost the same wherever it stands.
        def end(p: Column, w: Column) -> Column:
            return F.struct(F.right(p, F.lit(NEAR)).alias("last"), F.left(p, F.lit(wide)).alias("first"), F.left(w, F.lit(wide)).alias("m"), F.right(w, F.lit(NEAR)).alias("n"))

        rest = F.slice(ps, F.size(ms) + 1, F.lit(1))
        ends = F.concat(F.transform(own, lambda x: end(x["p"], x["w"])), F.transform(rest, lambda p: end(p, F.lit(""))))

        def surrounded(ends: Column) -> Column:
            def one(x: Column) -> Column:
                i, low = x["i"], F.greatest(x["i"] - -(-NEAR // kind.least), F.lit(0))
                before = F.concat(F.array_join(F.transform(F.slice(ends, low + 1, i - low), lambda e: F.concat(e["last"], e["n"])), ""), F.get(ends, i)["last"])
                after = F.array_join(F.transform(F.slice(ends, i + 2, F.lit(-(-wide // kind.least))), lambda e: F.concat(e["first"], e["m"])), "")
                return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(wide)).alias("after"))

            return F.transform(at, one)

        return F.get(F.transform(F.array(ends), surrounded), F.lit(0))

    pieces = F.split(text, kind.pattern, -1)
    both = F.array(F.struct(matches.alias("ms"), pieces.alias("ps")))
    spans = F.get(F.transform(both, lambda x: placed(x["ms"], x["ps"])), F.lit(0))  # binds both
    if kind.prefixes:
        shorter = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), longest(kind, x["value"]).alias("value"), x["before"].alias("before"), x["after"].alias("after")))
        # What comes after a match's beginning begins with the rest of its value.
        rest = lambda x: F.substr(x["after"], F.length(x["value"]) - 3, F.lit(NEAR))
        spans = apart(F.transform(shorter, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["before"].alias("before"), rest(x).alias("after"))))

    def scored(x: Column) -> Column:
        near = F.concat(x["before"], F.lit(" "), x["after"]).rlike(rf"(?i)\b(?:{kind.words})")
        score = F.lit(kind.score) + F.when(near, BONUS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), F.round(score, 3).alias("score"))

    spans = F.transform(spans, scored)
    if kind.needs_words:
        spans = F.filter(spans, lambda x: x["score"] >= ACCEPT)
    return F.when(F.size(matches) > 0, spans).otherwise(F.array()).cast(SPAN)


def spans(text: Column) -> Column:
    """All kinds' spans of a text (null: empty), by start and then kind. Base kinds only need their checks; others need ACCEPT."""
    text = F.coalesce(text, F.lit(""))
    every = [found(text, i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*every))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans: one row a row of docs. A null or empty text has no spans; rows aren't compared, so repeats stay."""
    return docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text)).alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by <KIND>; overlapping spans become one, named by the first."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substr(F.coalesce(F.col(text), F.lit("")), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate(spans(F.col(text)), zero, step)
    return docs.withColumn(text, F.when(F.col(text).isNull(), None).otherwise(F.concat(end["out"], F.substr(F.col(text), end["at"] + 1))))


def sql(documents: str = "documents") -> str:
    """The query's result in DuckDB's SQL, from the plain patterns."""
    esc = lambda x: x.replace("'", "''")
    tables = " UNION ALL ".join(
        f"SELECT doc_id, t, '{k.name}' AS kind, {i} AS ord, {str(k.base).lower()} AS base, '{k.words}' AS words, "
        f"regexp_extract_all(t, '{esc(k.plain)}') AS ms, string_split_regex(t, '{esc(k.plain)}') AS ps FROM d"
        for i, k in enumerate(KINDS)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}),
m AS ({tables}),
u AS (SELECT doc_id, t, kind, ord, base, words, unnest(ms) AS v, unnest(ps[1:len(ms)]) AS p, unnest(generate_series(1, len(ms))) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT *, CAST(sum(length(p) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS n,
      replace(v, ' ', '') AS w FROM u),
g AS (SELECT *, e - length(v) AS b,
      CASE WHEN kind = 'card' AND length(n) BETWEEN 14 AND 19 THEN
        (SELECT sum(CASE WHEN k % 2 = 0 THEN CASE WHEN 2 * c > 9 THEN 2 * c - 9 ELSE 2 * c END ELSE c END) % 10 = 0
         FROM (SELECT k, CAST(substr(reverse(n), k, 1) AS INT) AS c FROM (SELECT unnest(generate_series(1, length(n))) AS k))) ELSE false END AS luhn,
      CASE WHEN kind = 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr(w, 5) || substr(w, 1, 4), ''), lambda c: ord(c))),
        lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1 ELSE false END AS mod97
      FROM s),
x AS (SELECT doc_id, kind, ord, base, b, e FROM g WHERE CASE kind
      WHEN 'ip' THEN regexp_full_match(v, '{PART}(?:\.{PART}){{3}}') WHEN 'card' THEN luhn WHEN 'phone' THEN length(n) BETWEEN 10 AND 15
      WHEN 'iban' THEN mod97
      WHEN 'ssn' THEN regexp_matches(substr(t, greatest(b - {NEAR}, 0) + 1, b - greatest(b - {NEAR}, 0)) || ' ' || substr(t, e + 1, {NEAR}), '(?i)\b(?:' || 'ssn|social|security' || ')')
      ELSE true END),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
      count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
      coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (WHERE base), '') AS base,
      coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord), '') AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""
