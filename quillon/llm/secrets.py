"""Secret scans (operator 8): a random forest over candidates, with DataFrame and ML operations of the JVM only.

A candidate is a long run of key characters, a value of at least eight characters that is assigned to a name with = or :
(quoted, or unquoted up to white space or a quote, without closing punctuation), or the head of a private key. A run ends
before the = or : of an assignment, so a value is judged with its name on the left.
Its features are its length, its transitions between characters (changes of class, and how many pairs of letters are
those of common words), the share that dictionary words cover, signs of a path, and the words before and after it. None of them knows
the form of a vendor's keys or a list of placeholders. A forest, trained from labelled findings, removes the false positives.

The labelled findings at hand are made by a rule (FINDINGS of them, the documented bound): keys and passwords of common
forms in their usual places, and the hashes, names, paths, numbers, words and placeholders that scanners mistake for them.
Any other findings (left, candidate, right, label) can be given instead.

Texts are read once; what leaves the scan is a row for each candidate, so no text is shuffled. Places are code points.

Defined results: a null or empty text has no candidate; repeated rows give their findings as often as they occur; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, table, with_types

FINDINGS, TREES, DEPTH, AROUND, LEAST = 4800, 30, 8, 60, 0.5

CANDIDATE = (
    r"""-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|(?<=[=:][ ]?["'])[^\s"']{8,}+(?=["'])"""
    r"""|(?<=[A-Za-z0-9_"'\])][ ]{0,2}[=:][ ]{0,4})(?!//)[^\s"']{7,}[^\s"',;.)\]}>]"""
    r"""|(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![^\s"'])|(?!["']?[ ]{0,2}[=:][ ]{0,4}["']?[^\s"']{8}))"""
)

# Common words of prose and of source code.
DICTIONARY = tuple("the and that with from this have which there would about other value name file data test example config default user admin login client server service system class function return string number index list array object public static import export module package version build release update create delete select insert table column query result error warning info debug message response request handler manager factory controller model view action event state store cache session cookie page title content image style script button form input label text color width height http https www com org net html json path home local src lib bin main begin end your here key token secret password".split())
# Frequent pairs of letters in words of European languages.
PAIRS = tuple("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ch ei ie un ge sc ue qu ai au eu la".split())
# Words that stand before secrets, and before harmless hashes and identifiers.
BEFORE_SECRET = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api.?key|access.?key|credentials?|auth|bearer|private.?key)[^A-Za-z0-9]{0,8}$"
BEFORE_HARMLESS = r"(?i)(commit|sha-?\d*|md5|checksum|hash|digest|uuid|guid|id|revision|version|build|url|href|src|path|file|integrity|etag)[^A-Za-z0-9]{0,8}$"

NAMES = ("length", "digits", "uppers", "lowers", "others", "changes", "pairs", "distinct", "hex", "dictionary", "longest_letters", "slashes", "path_before", "secret_before", "harmless_before", "assigned", "quoted")


def features(x: DataFrame) -> DataFrame:
    """Adds the features to a table with left, candidate and right (the text around)."""
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)) / n
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    low = F.lower(c)
    values = {
        "length": n,
        "digits": count("[0-9]"),
        "uppers": count("[A-Z]"),
        "lowers": count("[a-z]"),
        "others": count("[^A-Za-z0-9]"),
        "changes": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z]{2})(?=[a-z])"),
        "pairs": F.regexp_count(low, F.lit(f"(?=({'|'.join(PAIRS)}))")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$") & c.rlike("[a-fA-F]")),
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / n,
        "slashes": count("/"),
        "path_before": flag(left.rlike(r"[/\\.@#]$|https?:\S*$")),
        "secret_before": flag(left.rlike(BEFORE_SECRET)),
        "harmless_before": flag(left.rlike(BEFORE_HARMLESS)),
        "assigned": flag(left.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
    }
    return x.withColumns({name: values[name].cast("double") for name in NAMES})


def findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings by rule: left, candidate, right, label."""
    i = F.col("id")
    word = lambda k: F.get(F.array(*map(F.lit, DICTIONARY)), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(DICTIONARY))).cast("int"))
    pair = lambda k: F.get(F.array(*map(F.lit, PAIRS)), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PAIRS))).cast("int"))
    syllables = lambda a, b: F.concat(*[pair(k) for k in range(a, b)])
    text = F.concat(word(1), F.lit(" "), syllables(20, 23), F.lit(" "), word(2), F.lit(" "))
    hexa = F.sha2(i.cast("string").cast("binary"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexa)), "[=]", "")
    pick = lambda *c: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in c]), F.pmod(F.xxhash64(i, F.lit(99)), F.lit(len(c))).cast("int"))
    named = pick("token", "secret", "password", "api_key", "access_key", "auth_token", "API_KEY", "passwd", "client_secret")
    sign = pick(' = "', ': "', "=", ": ", '="', " = '")
    after = F.when(sign.endswith('"'), '" ').when(sign.endswith("'"), "' ").otherwise(" ")
    assigned = F.concat(text, named, sign)
    harmless = F.concat(text, pick("commit ", "sha1: ", "checksum = ", "md5 ", "build id ", "digest: ", "etag=", "revision "))
    ids = F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(hexa, 21, 12))
    kinds: list[tuple[Column, Column, Column, int]] = [
        (assigned, F.substring(hexa, 1, 40), after, 1),
        (assigned, F.substring(hexa, 1, 32), after, 1),
        (assigned, hexa, after, 1),
        (assigned, F.substring(mixed, 1, 40), after, 1),
        (assigned, F.substring(mixed, 1, 24), after, 1),
        (assigned, F.concat(syllables(5, 8), F.substring(mixed, 1, 7), F.lit("!9")), after, 1),
        (text, F.concat(F.lit("AKIA"), F.upper(F.substring(hexa, 1, 16))), F.lit(" "), 1),
        (text, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(mixed, "[+/]", "Q"), 1, 36)), F.lit(" "), 1),
        (text, F.concat(F.lit("sk-"), F.substring(F.regexp_replace(mixed, "[+/]", "z"), 1, 32)), F.lit(" "), 1),
        (text, F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.lit("\n"), 1),
        (harmless, F.substring(hexa, 1, 40), F.lit(" "), 0),
        (harmless, F.substring(hexa, 1, 32), F.lit(" "), 0),
        (F.concat(text, pick("id=", "uuid ", "guid: ")), ids, F.lit(" "), 0),
        (text, syllables(5, 14), F.lit(". "), 0),
        (text, F.substring(F.regexp_replace(hexa, "[a-f]", "7"), 1, 16), F.lit(" "), 0),
        (text, F.concat(F.initcap(word(3)), F.initcap(word(4)), F.initcap(word(5)), F.initcap(word(6))), F.lit("("), 0),
        (F.concat(text, F.lit("https:/")), F.concat(F.lit("/"), word(3), F.lit("/"), word(4), F.lit("/"), syllables(5, 9)), F.lit(".html"), 0),
        (assigned, pick("your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "example-token-value", "changeme_changeme", "1234567890123456"), after, 0),
        (assigned, F.concat_ws("_", word(3), word(4), word(5), word(6)), after, 0),
        (text, F.concat(F.lit("---------"), F.lit("=========")), F.lit("\n"), 0),
        (F.concat(text, word(7), F.lit(' = "')), F.concat(word(3), F.lit("/"), word(4), F.lit("/"), syllables(5, 9)), F.lit('" '), 0),
        (text, F.substring(hexa, 1, 40), F.lit(" "), 0),
        (F.concat(text, word(8), F.lit(': "')), F.concat(syllables(5, 8), F.lit("-"), syllables(9, 12), F.lit("-"), syllables(13, 15)), F.lit('" '), 0),
        (F.concat(text, word(8), F.lit('="')), syllables(5, 14), F.lit('" '), 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))

    def case(k: int) -> Column:
        out = F.lit(None)
        for at in reversed(range(len(kinds))):
            out = F.when(kind == at, kinds[at][k]).otherwise(out)
        return out

    return spark.range(0, n, 1, 1).select(case(0).alias("left"), case(1).alias("candidate"), case(2).alias("right"), case(3).cast("int").alias("label"))


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest from labelled findings, a bounded table: left, candidate, right, label (1: a secret)."""
    rows = cut(features(labelled).select(*NAMES, F.col("label").cast("double").alias("label")).coalesce(1))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt")
    return forest.fit(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, left, candidate, right) of every candidate of every text."""
    x = with_types(docs, doc_id="long", text="string").withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    x = x.select(F.monotonically_increasing_id().alias("row"), "doc_id", "found", F.split("text", CANDIDATE).alias("gaps"))
    each = x.select("row", "doc_id", "gaps", F.posexplode("found").alias("k", "candidate"))
    gap = F.get("gaps", F.col("k"))
    each = each.select("row", "doc_id", "k", "candidate", F.length(gap).alias("gap"), F.right(gap, F.lit(AROUND)).alias("left"), F.left(F.get("gaps", F.col("k") + 1), F.lit(AROUND)).alias("right"))
    upto = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("candidate")).over(upto)
    return each.select("doc_id", (end - F.length("candidate")).cast("long").alias("start"), end.cast("long").alias("end"), "left", "candidate", "right")


def judged(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Adds score, the forest's share for a secret."""
    x = model.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(features(found)))
    return x.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(findings(spark))
    x = judged(candidates(table(spark, sf_dir, "documents")), model)
    return x.where(F.col("score") >= LEAST).select("doc_id", "start", "end", F.sha2("candidate", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
