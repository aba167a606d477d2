"""Personal data, found and judged by DataFrame functions alone.

Regular expressions propose candidates, left to right without overlap for each kind; checks confirm them
(Luhn for cards, mod 97 for IBANs, ranges and digit counts for addresses and phone numbers); words in the
``CONTEXT`` characters before a candidate, back to the candidate before it, adjust its score, and so does a word that opens brackets right
behind it. Candidates of a list, with no letter between them, share the words before its first one. What a pattern matches and a check
refuses is dropped without another try inside it. An IBAN ends at its country's length, so words and numbers after it are not taken in.

The text between candidates and the candidates alternate, so places follow from running lengths; all work is
linear in the text. Patterns are possessive and may not start inside a run that a
start before has been through, so very long runs take neither a deep stack nor quadratic time; what they match is
what the plain patterns of the contract match.

Cases: null and empty texts have no spans; repeated rows have equal spans; an empty table gives an empty result;
places count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import texts

CONTEXT = 40
#: Of the brackets behind a candidate.
CONTEXT_AFTER = 24
#: No kind's candidates are shorter, so ``CONTEXT`` characters reach over a bounded number of them.
SHORTEST = 4
#: Spans of the added kinds need this score.
THRESHOLD = 0.5
#: Candidates whose places are counted together.
BLOCK = 128
_LOCAL = "[A-Za-z0-9._%+-]"
SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of digits."""
    back = F.reverse(number)

    def add(total: Column, at: Column) -> Column:
        d = F.substring(back, at, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Of an IBAN of capital letters and digits."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, at: Column) -> Column:
        c = F.ascii(F.substring(turned, at, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), add) == 1


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(12, 19) & luhn(d)


def _iban(m: Column) -> Column:
    code = F.regexp_replace(m, " ", "")
    return F.length(code).between(15, 34) & mod97(code)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    may: Callable[[Column], Column]  # a cheap test that texts with candidates pass
    check: Callable[[Column], Column]
    score: float  # of what the check confirms
    words: str  # that raise the score by ``boost`` when they stand near
    boost: float
    base: bool = True


_CARD = "[0-9](?:[ -]?+[0-9]){11,}+"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Of the country's length, if neither capital nor digit follows without a space; else the longest run, up to where an IBAN of its country's length begins.
_IBAN_SIZED = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?+[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Z0-9])"
_IBAN = f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_SIZED}|[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{_IBAN_SIZED}))?+[A-Z0-9]){{11,30}}+)"
_SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Fixed order of kinds: that of the contract, then the added ones.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), 0.9, "mail|contact|kontakt|correo|courriel", 0.1),
    Kind("ip", _IP, lambda t: t.rlike(_IP), lambda m: m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"), 0.8, r"\bip\b|host|server|address|adresse", 0.1),
    Kind("card", _CARD, lambda t: t.rlike(_CARD), _card, 0.8, "card|visa|karte|carte|tarjeta|payment", 0.2),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15), 0.7, "call|phone|tel|fax|mobile", 0.2),
    Kind("iban", _IBAN, lambda t: t.rlike(_IBAN), _iban, 0.9, "iban|konto|account|compte|cuenta", 0.1, base=False),
    Kind("ssn", _SSN, lambda t: t.rlike(_SSN), lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, r"ssn|social\s+security|tax\s+id", 0.4, base=False),
)


def _judged(kind: Kind, x: Column) -> Column:
    """Score of a candidate; zero if its check refuses it."""
    near = F.lower(x["near"]).rlike(kind.words) | F.lower(x["behind"]).rlike(rf"^\s*[(\[]\s*(?:{kind.words})")
    score = F.when(kind.check(x["m"]), F.lit(kind.score) + F.when(near, kind.boost).otherwise(0.0)).otherwise(0.0)
    return score if kind.base else F.when(score >= THRESHOLD, score).otherwise(0.0)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _alternating(kind: Kind, text: Column) -> Column:
    """What stands between the candidate before and each candidate, the candidate, and its context; the last candidate is null."""
    reach = -(-CONTEXT // SHORTEST)

    def marked(cut: Column) -> Column:
        """The end of each part with its candidate, whose characters are marks."""
        ends = F.zip_with(cut["before"], cut["m"], lambda before, m: F.right(F.concat(before, F.repeat(F.lit("\0"), F.coalesce(F.length(m), F.lit(0)))), F.lit(CONTEXT)))
        return F.struct(cut["before"].alias("before"), cut["m"].alias("m"), ends.alias("ends"))

    def contexts(cut: Column) -> Column:
        def one(before: Column, i: Column) -> Column:
            earlier = F.array_join(F.slice(cut["ends"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), "")
            window = F.right(F.concat(earlier, F.right(before, F.lit(CONTEXT))), F.lit(CONTEXT))
            near = F.regexp_extract(F.regexp_replace(window, r"\x00[^\p{L}]*$", ""), r"[^\x00]*$", 0)
            behind = F.left(F.coalesce(F.get(cut["before"], i + 1), F.lit("")), F.lit(CONTEXT_AFTER))
            return F.struct(before.alias("before"), F.get(cut["m"], i).alias("m"), near.alias("near"), behind.alias("behind"))

        return F.transform(cut["before"], one)

    cut = F.struct(F.split(text, kind.pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))
    return _bound(cut, lambda c: _bound(marked(c), contexts))


def kind_spans(kind: Kind, number: int, text: Column) -> Column:
    """Spans of one kind. Places run within blocks of ``BLOCK`` candidates first, and block after block then, as an array that grows by one is copied each time."""
    none, size = F.array().cast(f"array<{SPAN}>"), F.lit(BLOCK)
    at = F.lit(0).cast("bigint").alias("at")

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        score = _judged(kind, x)
        own = F.struct(begin.cast("bigint").alias("start"), F.lit(number).alias("kind_no"), end.cast("bigint").alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        return F.struct(end.cast("bigint").alias("at"), F.when(x["m"].isNotNull() & (score > 0), F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"))

    def follow(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), x["kind_no"].alias("kind_no"), (x["end"] + state["at"]).alias("end"), x["kind"].alias("kind"), x["score"].alias("score")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def placed(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.size(parts) - 1) / size).cast("int"))
        blocks = F.transform(numbers, lambda k: F.aggregate(F.slice(parts, k * size + 1, size), F.struct(at, none.alias("out")), step))
        return F.flatten(F.aggregate(blocks, F.struct(at, F.array().cast(f"array<array<{SPAN}>>").alias("out")), follow, lambda state: state["out"]))

    return F.when(kind.may(text), _bound(_alternating(kind, text), placed)).otherwise(none)  # the candidates are used in each block


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, kind_no, end, kind, score), by start and then kind."""
    each = texts(docs).select("doc_id", *(kind_spans(k, n, F.col("text")).alias(k.name) for n, k in enumerate(KINDS)))
    return each.select("doc_id", F.array_sort(F.concat(*(k.name for k in KINDS))).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans as text, and their scores in the same order."""
    base = F.filter("spans", lambda x: x["kind_no"] < 4)
    count = lambda n: F.size(F.filter("spans", lambda x: x["kind_no"] == n)).cast("bigint").alias(f"n_{KINDS[n].name}")
    return pii_spans(docs).select("doc_id", *(count(n) for n in range(4)), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))


def redacted(text: Column, kind: Kind) -> Column:
    """The text with this kind's spans replaced by its name in brackets."""
    put = lambda x: F.concat(x["before"], F.when(x["m"].isNull(), F.lit("")).when(_judged(kind, x) > 0, F.lit(f"[{kind.name.upper()}]")).otherwise(x["m"]))
    return F.when(kind.may(text), F.array_join(F.transform(_alternating(kind, text), put), "")).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """All columns, with personal data in ``text`` replaced, kind after kind, and ``n_chars`` counted anew where it is there; null stays null."""
    columns, kinds = docs.columns, dict(docs.dtypes)
    for kind in KINDS:
        docs = docs.withColumn("text", redacted(F.col("text"), kind))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return docs.select(*columns)
