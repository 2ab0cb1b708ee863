"""Secret scan: wide candidates, false positives removed by a random forest. DataFrame functions only.

Candidates are values assigned to something named like a credential, and any run of 16 key characters or more, so long
words, paths and digests are among them; that is high recall by design, and the forest has to turn most of them down. A random forest,
trained from labelled findings, scores each from its length, how its characters change class, how much of it dictionary
words cover, how path-like it is, and the words next to it. The forest is compiled into an expression, so the scan is one
projection of the text: no shuffle, and nothing but what the JVM runs.

No table labels findings, so those for training are made by rule (:func:`labelled`): keys in usual formats, and what scanners
mistake for them. Labelled findings of one's own can be given instead (:class:`Forest`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .spans import apart, around, assemble, find, pieces, tree_sum

#: The value of an assignment to a credential-like name, or a long run of key characters.
_ASSIGNED = r"(?i)(?:(?<=(?:secret|token|passwd|password|api_key|apikey|access_key|credential|private_key)[\"' ]{0,2}[:=][\"' ]{0,3})[^\s\"'<>,;]{8,}+)"
_RUN = r"(?<![A-Za-z0-9_/+=.-])[A-Za-z0-9_/+=.-]{16,}+"

#: Fixed list: common words and parts of names that keys do not hold.
WORDS = (
    "about|after|again|also|back|because|before|build|cache|class|code|commit|config|count|data|date|default|demo|driver|example|file|"
    "first|from|here|home|image|index|info|item|lib|line|list|local|main|model|name|note|number|page|part|path|place|sample|service|"
    "source|start|state|string|system|table|test|text|that|this|time|type|user|value|version|view|with|word|work|world|your"
)

#: Fixed list: syllables that prose is made of, for findings that are only long words.
SYLLABLES = "ation ing er the en sch ung lich eau que tion ment ción para los re ver in an or ou ai ente über".split()

NAMES = ["length", "lower_digit", "digit_lower", "upper_digit", "case", "digit_share", "upper_share", "letters", "hex", "dictionary", "repeat", "distinct", "slashes", "dots", "dashes", "extension", "known", "placeholder", "assigned", "quoted", "cue_secret", "cue_hash", "cue_path"]


def features(c: Column) -> dict[str, Column]:
    """Features of a candidate (struct of v, before, after)."""
    v, before = c["v"], c["before"]
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    flag = lambda x: x.cast("double")
    return {
        "length": F.length(v).cast("double"),
        "lower_digit": count("[a-z](?=[0-9])") / n,
        "digit_lower": count("[0-9](?=[a-z])") / n,
        "upper_digit": count("[A-Z](?=[0-9])|[0-9](?=[A-Z])") / n,
        "case": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "letters": count("[A-Za-z]{5,}"),
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(v), WORDS, ""))) / n,
        "repeat": flag(v.rlike(r"(.)\1\1\1")),
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        "slashes": count("/"),
        "dots": count(r"\."),
        "dashes": count("[-_]"),
        "extension": flag(v.rlike(r"(?i)\.(?:com|org|net|html?|php|js|py|jpg|png|json|txt|csv|java|so|jar)\b")),
        "known": flag(v.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|AIza|glpat-|eyJ)")),
        "placeholder": flag(v.rlike(r"(?i)your|example|changeme|placeholder|xxxx|1234567|dummy|<|\$\{")),
        "assigned": flag(before.rlike(r"[:=][\"' ]{0,3}$")),
        "quoted": flag(before.rlike("[\"']$")),
        "cue_secret": flag(before.rlike(r"(?i)(?:secret|token|passw(?:or)?d|api.?key|access.?key|credential|private.?key|auth|bearer)[^\w]{0,6}$")),
        "cue_hash": flag(before.rlike(r"(?i)(?:commit|sha1|sha256|md5|checksum|digest|etag|uuid|revision|hash|integrity)[^\w]{0,6}$")),
        "cue_path": flag(before.rlike(r"(?i)(?:https?:/*|path|file|dir|url|import|open)[^\w]{0,6}$")),
    }


def _pick(key: Column, salt: str, options: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(options))).cast("int"))


def labelled(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Findings made by rule: columns c (v, before, after), label, part (3 of 4 is held out)."""
    key = F.col("id")
    drawn = lambda s: F.sha2(F.concat(key.cast("string"), F.lit(s)), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(drawn("m"), drawn("n")))), "[/+=]", "x")
    n = (F.pmod(F.xxhash64(key, F.lit("n")), F.lit(30)) + 20).cast("int")
    shape = F.pmod(F.xxhash64(key, F.lit("shape")), F.lit(8))
    word = lambda s: _pick(key, s, WORDS.split("|"))
    good = key % 2 == 0
    secret = (
        F.when(shape == 0, F.sha1(drawn("a")))
        .when(shape == 1, F.substring(mixed, F.lit(1), n))
        .when(shape == 2, F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))))
        .when(shape == 3, F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)))
        .when(shape == 4, F.substring(drawn("b"), 1, 32))
        .when(shape == 5, F.concat(F.lit("eyJ"), mixed, F.lit("."), F.concat_ws("", *[F.substring(F.base64(F.unhex(drawn(f"j{i}"))), 1, 40) for i in range(4)])))
        .when(shape == 6, F.substring(mixed, F.lit(1), F.lit(16)))
        .otherwise(F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)))
    )
    # A long word of prose: syllables, as words that no dictionary holds have them too.
    prose = F.concat_ws("", *[_pick(key, f"syllable{i}", SYLLABLES) for i in range(7)], _pick(key, "stop", ["", "", ".", ".--"]))
    case = F.pmod(F.xxhash64(key, F.lit("case")), F.lit(4))
    prose = F.when(case == 0, F.upper(prose)).when(case == 1, F.initcap(prose)).otherwise(prose)
    not_secret = (
        F.when(shape == 0, F.sha1(drawn("c")))
        .when(shape == 1, F.concat(F.lit("/"), F.concat_ws("/", word("p"), word("q"), word("r")), (key % 97).cast("string"), _pick(key, "ext", [".html", ".png", ".js", ".txt"])))
        .when(shape == 2, F.concat(word("p"), F.initcap(word("q")), F.initcap(word("r")), F.initcap(word("s")), (key % 89).cast("string")))
        .when(shape == 3, F.concat(_pick(key, "ph", ["your-token-here-", "xxxxxxxxxxxxxxxxxxxx", "changeme-example-", "example_key_1234567"]), (key % 10).cast("string")))
        .when(shape == 4, F.concat_ws("-", *[F.substring(drawn("u"), 1 + 4 * i, k) for i, k in enumerate((8, 4, 4, 4, 12))]))
        .when(shape.isin(5, 6), prose)
        .otherwise(F.concat(F.repeat(word("p"), 4), (key % 7).cast("string")))
    )
    named = ['token = "', "secret: ", "password='", 'api_key = "', "access_key=", 'private key: "', 'auth: "']
    free = ["the ", "is ", "and ", "", ". ", ", "]
    dull = ["commit ", "sha1: ", "the file ", "md5 = ", "uuid: ", "open ", "path=", "etag: \"", "see ", "checksum "]
    # Which words stand before does not follow from the label but for hexadecimal digests, which nothing else tells apart.
    cue = F.when((shape == 0) | (shape == 4), F.when(good, _pick(key, "cue", named)).otherwise(_pick(key, "dull", dull))).otherwise(F.when(F.pmod(F.xxhash64(key, F.lit("place")), F.lit(5)) < F.when(good, 3).otherwise(1), _pick(key, "cue", named)).otherwise(_pick(key, "free", [*free, *dull[-2:]])))
    c = F.struct(F.when(good, secret).otherwise(not_secret).alias("v"), cue.alias("before"), F.lit('"').alias("after"))
    return spark.range(rows).select(c.alias("c"), good.cast("double").alias("label"), F.pmod(F.xxhash64(key, F.lit("part")), F.lit(4)).alias("part"))


class Forest:
    """Fitted once, applied as an expression: the mean over trees of the share of secrets in the leaf."""

    def __init__(self, spark: SparkSession, rows: int = 6000, trees: int = 20, depth: int = 6, findings: DataFrame | None = None) -> None:
        from pyspark.ml.regression import RandomForestRegressor

        made = findings if findings is not None else labelled(spark, rows)
        data = assemble(made, features(F.col("c"))).filter("part < 3").cache()
        # On 0/1 labels, variance is half the Gini impurity, and a leaf's mean is its share of secrets.
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(data)
        data.unpersist()
        self.debug, self.trees = model.toDebugString, trees

    def score(self, c: Column) -> Column:
        f = features(c)
        return let(F.struct(*[f[n].alias(n) for n in NAMES]), lambda x: tree_sum(self.debug, [x[n] for n in NAMES]) / self.trees)


def scan(docs: DataFrame, text_col: str = "text", *, threshold: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of all input columns) and ``findings``: array of (s, e, p, secret).

    Places are code points, the end exclusive; ``p`` is the score, ``secret`` whether it reaches ``threshold``. Null and empty
    texts have no findings; repeated rows are scanned each by itself; an empty table gives an empty result.
    """
    forest = forest or Forest(docs.sparkSession)
    read = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")

    def full(x: Column) -> Column:
        before, after = around(F.col("_held"), x, 32, 4)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), before.alias("before"), after.alias("after"))

    low = F.lower(text)
    named = F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("passw")) | F.contains(low, F.lit("key")) | F.contains(low, F.lit("credential"))
    found = read.select("row", "_text", find(text, _ASSIGNED, named).alias("a"), find(text, _RUN, text.rlike(r"[A-Za-z0-9_/+=.-]{16}")).alias("r"))
    found = found.select("row", "_text", F.concat("a", apart(F.col("r"), F.col("a"))).alias("all"))
    found = found.select("row", "all", F.when(F.size("all") > 0, pieces(text)).otherwise(F.array().cast("array<string>")).alias("_held"))
    both = found.select("row", F.transform("all", full).alias("c"))
    scored = F.transform("c", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), forest.score(c).alias("p")))
    kept = F.transform(scored, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["p"].alias("p"), (c["p"] >= threshold).alias("secret")))
    return both.select("row", F.when(F.size("c") == 0, F.array().cast("array<struct<s:int,e:int,p:double,secret:boolean>>")).otherwise(F.sort_array(kept)).alias("findings"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Per document: candidates, secrets, and where the secrets are (start:end, comma-joined)."""
    hits = F.filter("findings", lambda x: x["secret"])
    return scan(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(hits).cast("long").alias("n_secrets"),
        F.array_join(F.transform(hits, lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"),
    )
