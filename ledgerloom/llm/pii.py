"""Personal data: base rules, plus high-recall candidates scored by gradient-boosted trees. DataFrame functions only.

Base spans (email, ip, card, phone) are kept always. Generators propose further spans that the base rules cannot give, such
as two cards divided by one space, a number without country code, or a spelled-out address; they may overlap. Boosted
trees score each from its format and context; a threshold per kind, set on held-out labelled candidates for a precision
of 98 %, selects; of overlapping spans the likelier stays. The trees are compiled into an expression, so the whole is one
projection of the text: no shuffle, and nothing but what the JVM runs.

The labelled candidates are made by rule (:func:`labelled`), so the model needs no corpus and is the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .spans import apart, around, assemble, cut, digits, find, listed, luhn, pieces, running, tree_sum

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]

#: Base patterns. Possessive where that cannot change a match, so no text makes them backtrack far.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further candidates: pattern, and a cheap test for texts that may have any.
GENERATORS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[(\[{]at[)\]}]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[{]dot[)\]}]|(?<= )dot(?= )) ?[A-Za-z0-9-]{2,63}+){1,4}+", r"[(\[{ ]dot[)\]} ]"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])", r"[0-9]{13}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"),
    "phone": (r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
}

#: The longest candidate has 413 characters (an email), the shortest 7 (an ip), and matches of one kind do not overlap: of those
#: sorted by start, at most so many before and after one can meet it.
REACH = len(GENERATORS) * (413 // 7 + 1)

_CUES = {
    "cue_call": r"(?i)\b(?:call|tel|phone|mobile|cell|fax|dial|whatsapp)\b",
    "cue_pay": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment|iban|bank|account)\b",
    "cue_net": r"(?i)\b(?:ip|host|server|from|address|login|client)\b",
    "cue_mail": r"(?i)\b(?:e-?mail|contact|write|reach|mail)\b",
    "cue_person": r"(?i)\b(?:ssn|social security|born|passport|name)\b",
    "cue_other": r"(?i)\b(?:order|invoice|version|ver|release|ref|serial|part|isbn|item|build|section|chapter|v)\b\W*$",
}


def base_spans(text: Column) -> dict[str, Column]:
    """The contract's spans by kind; matches that fail their check are dropped."""
    numeric = text.rlike("[0-9]")
    n = lambda x: F.length(digits(x["v"]))
    octets = lambda x: F.forall(F.split(x["v"], r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 4) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    return {
        "email": find(text, _EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find(text, _IP, numeric & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), octets),
        "card": F.filter(find(text, _CARD, numeric & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda x: n(x).between(16, 19) & luhn(x["v"])),
        "phone": F.filter(find(text, _PHONE, F.contains(text, F.lit("+"))), lambda x: n(x).between(8, 15)),
    }


def features(c: Column) -> dict[str, Column]:
    """Format and context features of a candidate (struct of kind, v, before, after)."""
    v, before, after = c["v"], c["before"], c["after"]
    flag = lambda x: x.cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    d = digits(v)
    out = {f"is_{k}": flag(c["kind"] == k) for k in KINDS}
    out |= {
        "length": F.length(v).cast("double"),
        "digits": F.length(d).cast("double"),
        "letters": count("[A-Za-z]"),
        "gaps": count("[ .-]"),
        "luhn": flag(luhn(v)),
        "issuer": flag(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "octets": flag(v.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")),
        "zeros": flag(v.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$|^0+[. -]|^[(]?[01]")),
        "same": flag(d.rlike(r"^([0-9])\1+$")),
        "glued_left": flag(before.rlike(r"[A-Za-z0-9.:/#_-]$")),
        "glued_right": flag(after.rlike(r"^(?:[A-Za-z0-9_:/-]|[.][0-9])")),
        "known_end": flag(v.rlike(r"(?i)\b(?:com|org|net|edu|gov|io|de|fr|es|uk)$")),
        **{n: flag(before.rlike(p)) for n, p in _CUES.items()},
    }
    return out


def _pick(key: Column, salt: str, options: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(options))).cast("int"))


def _number(key: Column, salt: str, n: int, low: int = 0) -> Column:
    """``n`` digits, drawn by hash; at most 18."""
    return F.lpad((F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(10**n - low)) + low).cast("string"), n, "0")


def labelled(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled candidates made by rule: columns c (kind, v, before, after), label, part.

    Half of them are personal data in usual formats and contexts, half look alike and are not: wrong check digits, parts over
    255, versions, order numbers, impossible social security numbers. ``part`` 3 of 4 is for thresholds.
    """
    key = F.col("id")
    kind = F.get(F.array(*map(F.lit, KINDS)), (key % 6).cast("int"))
    good = (F.floor(key / 6) % 2 == 0)
    body = _number(key, "card", 15)
    check = let(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("4"), F.substring(body, 2, 14), i.cast("string"))), lambda xs: F.get(F.filter(xs, luhn), F.lit(0)))
    card = F.when(good, check).otherwise(F.concat(F.substring(check, 1, 15), ((F.substring(check, 16, 1).cast("int") + 1 + F.pmod(F.xxhash64(key), F.lit(9)).cast("int")) % 10).cast("string")))
    spaced = F.concat_ws(" ", *[F.substring(card, 4 * i + 1, 4) for i in range(4)])
    octet = lambda s: F.pmod(F.xxhash64(key, F.lit(s)), F.lit(254)) + 1
    ip = F.concat_ws(".", *[octet(f"o{i}").cast("string") for i in range(3)], F.when(good | (key % 4 < 2), octet("o3")).otherwise(octet("o3") + 300).cast("string"))
    name = _pick(key, "name", ["ann.lee", "j.doe", "marta", "k_ito", "info", "sales.team", "paul77"])
    host = _pick(key, "host", ["mail", "example", "post", "home-net", "uni"])
    end = F.when(good, _pick(key, "end", ["com", "org", "net", "de", "fr"])).otherwise(_pick(key, "bad", ["plot", "red", "more", "that", "noon"]))
    email = F.when(key % 2 == 0, F.concat(name, F.lit(" (at) "), host, F.lit(" (dot) "), end)).otherwise(F.concat(name, F.lit(" at "), host, F.lit(" dot "), end))
    area = F.concat(F.lit("2"), _number(key, "area", 2))
    phone = F.when(good, F.concat(F.lit("("), area, F.lit(") "), _number(key, "p", 3, 200), F.lit("-"), _number(key, "q", 4))).otherwise(F.concat(F.lit("0"), _number(key, "area", 2), F.lit("."), _number(key, "p", 3), F.lit("."), _number(key, "q", 4)))
    ssn = F.concat(F.when(good, _number(key, "s", 3, 100)).otherwise(_pick(key, "s0", ["000", "666", "912", "987"])), F.lit("-"), F.concat(F.lit("1"), _number(key, "t", 1)), F.lit("-"), F.concat(F.lit("2"), _number(key, "u", 3)))
    ssn = F.when(good & ssn.rlike("^(?:666|9)"), F.concat(F.lit("5"), F.substring(ssn, 2, 10))).otherwise(ssn)
    iban = F.concat(_pick(key, "land", ["DE", "FR", "ES", "GB"]), _number(key, "i", 2), F.lit(" "), F.concat_ws(" ", *[_number(key, f"i{j}", 4) for j in range(4)]))
    iban = F.when(good, iban).otherwise(F.concat(_pick(key, "land", ["NO", "AB", "XX", "SN"]), _number(key, "i", 2), F.regexp_replace(F.substring(F.upper(F.sha1(key.cast("string"))), 1, 14), "[0-9]", "A")))
    cues = {"email": ["mail me: ", "contact ", "write to "], "ip": ["from ", "login from ip ", "host "], "card": ["card ", "paid by visa ", "credit "], "phone": ["call ", "phone: ", "tel "], "ssn": ["ssn ", "social security ", "name, "], "iban": ["iban ", "bank account ", "to "]}
    decoys = ["version ", "order ", "ref ", "part ", "build ", "serial "]
    cue = F.when(good, F.coalesce(*[F.when(kind == k, _pick(key, "cue", [*v, "and the ", "is "])) for k, v in cues.items()])).otherwise(F.when((key % 5 < 3) | (kind == "ip"), _pick(key, "decoy", decoys)).otherwise(_pick(key, "none", ["and the ", "was ", "of "])))
    v = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.when(key % 3 == 0, spaced).otherwise(card)).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(iban)
    c = F.struct(kind.alias("kind"), v.alias("v"), cue.alias("before"), _pick(key, "after", [" and", ".", ", ", " ", "\n"]).alias("after"))
    return spark.range(rows).select(c.alias("c"), good.cast("double").alias("label"), F.pmod(F.xxhash64(key, F.lit("part")), F.lit(4)).alias("part"))


class Scorer:
    """Trees and thresholds: fitted once, applied as an expression."""

    def __init__(self, spark: SparkSession, rows: int = 6000, trees: int = 15, precision: float = 0.98) -> None:
        from pyspark.ml.classification import GBTClassifier

        made = labelled(spark, rows)
        self.names = list(features(F.col("c")))
        data = assemble(made, features(F.col("c"))).cache()
        model = GBTClassifier(maxIter=trees, maxDepth=4, seed=7, stepSize=0.3).fit(data.filter("part < 3"))
        data.unpersist()
        self.debug = model.toDebugString
        held = made.filter("part = 3").select(F.col("c.kind").alias("kind"), "label", F.round(self.score(F.col("c")), 2).alias("p"))
        tally = held.groupBy("kind", "p").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()  # at most 6 x 101 rows
        self.thresholds = {k: self._threshold([r for r in tally if r.kind == k], precision) for k in KINDS}

    @staticmethod
    def _threshold(rows: list, precision: float) -> float:
        """The lowest score from which the held-out candidates are precise enough, 0.5 at least; over 1 if there is none."""
        best, right, n = 1.01, 0.0, 0
        for r in sorted(rows, key=lambda r: -r.p):
            right, n = right + r.right, n + r.n
            if right >= precision * n and r.p >= 0.5:
                best = r.p
        return best

    def score(self, c: Column) -> Column:
        f = features(c)
        return let(F.struct(*[f[n].alias(n) for n in self.names]), lambda x: 1 / (1 + F.exp(-2 * tree_sum(self.debug, [x[n] for n in self.names]))))


def find_pii(docs: DataFrame, text_col: str = "text", *, scorer: Scorer | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of all input columns), ``base`` and ``added``: arrays of (kind, s, e).

    Places are code points, the end exclusive. Null texts count as empty and have no spans; repeated rows are searched each
    by itself; an empty table gives an empty result.
    """
    scorer = scorer or Scorer(docs.sparkSession)
    text = F.col("_text")
    tag = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    numeric = text.rlike("[0-9]")

    def proposed(kind: str) -> Column:
        pattern, gate = GENERATORS[kind]
        gated = text.rlike(gate) if kind == "email" else numeric & text.rlike(gate)
        return F.transform(find(text, pattern, gated), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    read = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    with_base = read.select("row", "_text", F.concat(*[tag(k, s) for k, s in base_spans(text).items()]).alias("base"), F.concat(*map(proposed, KINDS)).alias("candidates"))
    free = with_base.select("row", "_text", "base", apart(F.col("candidates"), F.col("base")).alias("free"))
    held = free.select("row", "base", "free", F.when(F.size("free") > 0, pieces(text)).otherwise(F.array().cast("array<string>")).alias("_held"))

    def full(x: Column) -> Column:
        before, after = around(F.col("_held"), x, 32, 8)
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), before.alias("before"), after.alias("after"))

    threshold = lambda c: F.coalesce(*[F.when(c["kind"] == k, F.lit(scorer.thresholds[k])) for k in KINDS])
    scored = held.select("row", "base", F.transform(F.transform("free", full), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), scorer.score(c).alias("p"), threshold(c).alias("t"))).alias("scored"))
    likely = F.when(F.size("scored") == 0, F.array().cast("array<struct<s:int,e:int,kind:string,p:double,t:double>>")).otherwise(F.sort_array(F.filter("scored", lambda c: c["p"] >= c["t"])))
    return scored.select("row", "base", let(likely, _likeliest).alias("added"))


def _likeliest(spans: Column) -> Column:
    """Of spans (s, e, kind, p) sorted by start those that meet none that is better: likelier, then longer, then earlier."""
    meets = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    better = lambda x, y: (x["p"] > y["p"]) | ((x["p"] == y["p"]) & ((x["e"] - x["s"] > y["e"] - y["s"]) | ((x["e"] - x["s"] == y["e"] - y["s"]) & ((x["s"] < y["s"]) | ((x["s"] == y["s"]) & (x["kind"] < y["kind"]))))))
    near = lambda i: F.slice(spans, F.greatest(i - REACH, F.lit(0)) + 1, F.lit(2 * REACH + 1))
    best = F.filter(spans, lambda c, i: ~F.exists(near(i), lambda o: meets(o, c) & better(o, c)))
    one_kind = F.size(F.array_distinct(F.transform(spans, lambda x: x["kind"]))) < 2
    return F.transform(F.when(one_kind, spans).otherwise(best), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.sort_array(F.transform(spans, lambda x: F.struct(place(x).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The query's columns, from :func:`find_pii`."""
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *map(count, ["email", "ip", "card", "phone"]),
        F.sha2(listed(_ordered(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        listed(_ordered(F.concat("base", "added"))).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", *, scorer: Scorer | None = None) -> DataFrame:
    """Documents (all columns) with every span replaced by its kind in angle brackets; overlapping spans by the first's.

    Null texts stay null, texts without spans as they are; repeated rows are treated each by itself; an empty table gives an
    empty result. Time is linear in the text and its spans.
    """
    found = find_pii(docs, text_col, scorer=scorer)
    text = F.col("row")[text_col]
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    placed = found.select("row", spans.alias("_spans")).select("row", "_spans", F.when(F.size("_spans") > 0, pieces(text)).otherwise(F.array().cast("array<string>")).alias("_held"))
    held = F.col("_held")

    def made(ends: Column) -> Column:
        def put(x: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            return F.when(x["s"] < at, "").otherwise(F.concat(cut(held, at, x["s"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))

        return F.concat(F.array_join(F.transform("_spans", put), ""), cut(held, F.element_at(ends, -1), F.length(text)))

    ends = running(F.transform("_spans", lambda x: x["e"]), F.lit(0), lambda a, x: F.greatest(a, x))
    new = F.when(F.size("_spans") == 0, text).otherwise(let(ends, made))
    return placed.select(*[(new if f.name == text_col else F.col("row")[f.name]).alias(f.name) for f in docs.schema])
