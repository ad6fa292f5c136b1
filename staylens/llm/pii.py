"""Personal data: regular expressions propose spans, checksums and digit
counts confirm them, words nearby adjust the score.

DataFrame functions only. A pattern's matches and the pieces between them
come from the same regular expression; running lengths of both give every
match its place in code points. The patterns are written without
backtracking (possessive), so long runs of letters or digits cost linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.shared import col, free_name

_LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str                 # finds the same strings as the rule it stands for
    score: float                 # of a confirmed span without context
    context: tuple[str, ...]     # words nearby that raise the score
    needs: str = ""              # character without which there is no match
    base: bool = True            # always reported, whatever the score


#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         ("mail", "email", "contact", "kontakt", "correo", "courriel"), "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, ("ip", "host", "server", "address", "login"), "."),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11,}+", 0.8, ("card", "visa", "credit", "karte", "tarjeta", "carte", "pay")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, ("phone", "call", "tel", "mobile", "fax", "telefon", "llama", "appel"), "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.9,
         ("iban", "bank", "account", "konto", "cuenta", "compte"), base=False),
)
#: Words nearby that say a number is something else.
OTHERWISE = ("version", "order", "invoice", "article", "isbn", "page", "build")
CONTEXT_CHARS = 40
#: A masked text is put together from blocks of this many code points.
BLOCK_CHARS = 256
RAISE, LOWER = 0.1, 0.3
#: Spans that are not base ones need this score.
KEEP_SCORE = 0.5


def _digits(s: Column) -> Column:
    return F.translate(s, " ().+-", "")


def _luhn(digits: Column) -> Column:
    """Is the Luhn sum of a string of digits a multiple of ten?"""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(s: Column) -> Column:
    """The check of an account number: letters count 10 to 35, the first four go last."""
    plain = F.translate(s, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return m.rlike(rf"\A{small}(?:\.{small}){{3}}\z")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _nearby(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(?i)\\b(?:" + "|".join(words) + ")")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it,
    also within functions of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Running totals of an array, by steps of 1, 2, 4, ... places: no array
    grows element by element, so n values cost n log n."""
    doubled = F.array(*(F.lit(1 << e) for e in range(31)))

    def all_of(v: Column) -> Column:
        def step(acc: Column, d: Column) -> Column:
            return F.transform(acc, lambda x, i: F.when(i >= d, combine(x, F.get(acc, i - d))).otherwise(x))

        return F.aggregate(F.filter(doubled, lambda d: d < F.size(v)), v, step)

    return _let(values, all_of)


def _found(kind: Kind, order: int, t: Column, matches: Column) -> Column:
    """Confirmed spans of one kind: start, kind's place, end, name, score."""
    def spans(between: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        return _let(_running(lengths, lambda x, y: x + y), lambda ends: F.transform(matches, lambda m, i: span(between, ends, m, i)))

    def span(between: Column, ends: Column, m: Column, i: Column) -> Column:
        around = F.concat_ws(" ", F.right(F.get(between, i), F.lit(CONTEXT_CHARS)), F.left(F.get(between, i + 1), F.lit(CONTEXT_CHARS)))
        score = _let(around, lambda a: F.least(
            F.lit(1.0), F.lit(kind.score) + F.when(_nearby(a, kind.context), RAISE).otherwise(0.0)
            - F.when(_nearby(a, OTHERWISE), LOWER).otherwise(0.0)))
        end = F.get(ends, i)
        return F.struct((end - F.length(m)).alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind.name).alias("kind"),
                        score.alias("score"), _confirmed(kind.name, m).alias("ok"))

    empty = F.expr("cast(array() as array<struct<start:int,kind_order:int,end:int,kind:string,score:double,ok:boolean>>)")
    kept = F.filter(_let(F.split(t, kind.pattern, -1), spans), lambda s: s["ok"] if kind.base else s["ok"] & (s["score"] >= KEEP_SCORE))
    return F.when(F.size(matches) > 0, kept).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Spans of personal data in every whole text.

    Returns all columns plus one array (named "pii", with underscores added
    if taken), and its name: spans (start, kind_order, end, kind, score, ok)
    by start, then kind as listed in KINDS; code points, end exclusive. Kinds
    that are not base need KEEP_SCORE after context; base kinds are always
    listed.

    Null and empty texts have no spans; repeated rows are each searched;
    spans of different kinds may overlap; an empty table stays empty.
    """
    out = free_name(docs, "pii")
    held = [free_name(docs, f"pii_{k.name}_") for k in KINDS]
    t = F.coalesce(col(text), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    digit = t.rlike("[0-9]")
    frame = docs.select("*", *(
        F.when((F.contains(t, F.lit(k.needs)) if k.needs else F.lit(True)) & (digit if k.name != "email" else F.lit(True)),
               F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(h)
        for k, h in zip(KINDS, held)))
    found = F.concat(*(_found(k, i, t, col(h)) for i, (k, h) in enumerate(zip(KINDS, held))))
    any_match = sum((F.size(col(h)) for h in held), F.lit(0)) > 0
    empty = F.expr("cast(array() as array<struct<start:int,kind_order:int,end:int,kind:string,score:double,ok:boolean>>)")
    return frame.select(*map(col, docs.columns), F.when(any_match, F.sort_array(found)).otherwise(empty).alias(out)), out


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text given in blocks; touches their blocks only."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    last = F.floor((end - 1) / BLOCK_CHARS).cast("int")
    joined = F.array_join(F.transform(F.sequence(first, last), lambda k: F.get(blocks, k)), "")
    return F.when(end > start, F.substring(joined, start - first * BLOCK_CHARS + 1, end - start)).otherwise("")


def _masked(text: Column, spans: Column) -> Column:
    """A text with the runs of its spans (sorted, at least one) replaced."""
    def runs(ends: Column) -> Column:
        fresh = lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1))
        firsts = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), fresh)
        return _let(firsts, lambda f: _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)),
                                           lambda blocks: shown(ends, f, blocks)))

    def shown(ends: Column, firsts: Column, blocks: Column) -> Column:
        def run(i: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(ends, i - 1)).otherwise(0)
            return F.concat(_cut(blocks, before, F.get(spans, i)["start"]), F.lit("["), F.upper(F.get(spans, i)["kind"]), F.lit("]"))

        rest = _cut(blocks, F.get(ends, F.size(ends) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(firsts, run), ""), rest)

    return _let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), runs)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with every span (overlapping ones together)
    replaced by its kind in brackets, the first one's where several overlap.
    Null and empty texts stay as they are, repeated rows are each masked. The
    work is linear in a text's length and n log n in its matches."""
    found, name = find_pii(docs, text)
    masked = F.when(F.size(col(name)) > 0, _masked(col(text), col(name))).otherwise(col(text))
    return found.select(*(masked.alias(c) if c == text else col(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, all spans."""
    found, name = find_pii(docs.select("doc_id", "text"))
    s = col(name)
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda k: lambda x: x["kind"] == k
    base = [k.name for k in KINDS if k.base]
    listed = F.concat_ws(",", F.transform(F.filter(s, lambda x: x["kind"].isin(base)), shown))
    return found.select("doc_id", *(F.size(F.filter(s, of(k))).cast("long").alias(f"n_{k}") for k in base),
                        F.sha2(listed.cast("binary"), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform(s, shown)).alias("spans"),
                        F.transform(s, lambda x: x["score"]).alias("scores"))
