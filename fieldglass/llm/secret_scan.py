"""Secrets in texts: candidates by pattern, judged by a random forest.

Everything is built from DataFrame functions and the JVM's own forest; no
Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, dropped, whole, written

#: What announces a secret: a name with a secret word, a sign of assignment, perhaps a quote.
LEAD = (
    r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{0,40}?(?i:token|secret|passwo?r?d|passphrase|pwd|api[_-]?key|auth|credentials?|bearer|private[_-]?key|access[_-]?key)"
    r"[A-Za-z0-9_-]{0,20}[\"'`]?(?:\s{0,3}[:=]{1,2}>?\s{0,3}|\s{1,3}(?=[\"'`]))[\"'`]?"
)
#: A candidate is what stands behind a lead, six characters or more; a token by a known prefix, dotted or not; a run of key
#: characters with a digit, 16 or more; or the head of a private key.
CANDIDATE = (
    LEAD + r"[^\s\"'`<>(){},;]{6,}"
    r"|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{12,}|gh[oprsu]_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{8,}|sk[_-](?:live_|test_)?[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{16,}|glpat-[A-Za-z0-9_-]{10,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){1,2})"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
#: Characters of the text on either side that are looked at.
NEAR = 60
THRESHOLD = 0.5
TRAINING_ROWS = 12_000
#: The most frequent words of all documents are known ones.
WORDS = 3000
TREES, DEPTH, SEED = 24, 8, 17

#: Dictionary words, words beside secrets and beside other long tokens.
DICTIONARY = """about account action after all and any app article base before between block book build by case chapter class code common
company config content count data date day default design document download edit error event example file find first for form from function
general get go group guide have header help high home how image index info install into item java just key last like line link list local
long main make many march may more most name new news not note now number off one online open order other our out page part path people
photo place play point post product public read release report result review right sample search section see service set show site size
small some source start state story system table team test text that the their them then there these they this time title to top type under
update use user value version video view was way web week were what when where which who will with work world year you""".split()
SECRET_WORDS = "token|secret|passw|pwd|api|key|auth|credential|bearer|access|private|signature"
OTHER_WORDS = r"(?<![a-z])(?:commit|sha|md5|uuid|guid|digest|version|order|card|isbn|checksum|hash|build|invoice|serial|phone|file|path|page|image|figure|section|url|http)(?![a-z]{2})"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk_live_|sk-|AIza|glpat-|-----BEGIN)"

FEATURES = [
    "length", "turns", "digits", "upper", "lower", "signs", "distinct", "likely", "vowels", "covered", "known", "hex", "number", "prefix",
    "slashes", "dashes", "in_path", "quoted", "assigned", "secret_word", "other_word", "longest_letters",
]


def _share(count: Column, length: Column) -> Column:
    return count.cast("double") / F.greatest(length, F.lit(1)).cast("double")


@dataclass(frozen=True)
class Prose:
    """What ordinary text looks like: log odds of 27 x 27 pairs of characters (the last is none of a-z), and frequent words."""

    pairs: tuple[float, ...]
    words: tuple[str, ...]


def learn_prose(docs: DataFrame, id_col: str, text_col: str) -> Prose:
    """Transitions between characters and frequent words of all documents; every row counts, whatever its id.

    Words are counted whole and distinct ones cut into pairs. At most 729 pairs
    and the ``WORDS`` most frequent words come back. Without documents all pairs
    are alike and only the built-in words are known.
    """
    words = columns_only(docs, text_col).select(F.explode(F.split(F.lower(whole(F.col(f"`{text_col}`"))), "[^a-z]+")).alias("w")).where("w != ''")
    counts = written(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    # one look ahead a place takes time in proportion to a word's length
    pair = counts.select("n", F.explode(F.regexp_extract_all(F.concat(F.lit(" "), "w", F.lit(" ")), F.lit("(?=(..))"), F.lit(1))).alias("p"))
    code = lambda x: ord(x) - 97 if x != " " else 26
    seen = {code(r["p"][0]) * 27 + code(r["p"][1]): r["n"] for r in pair.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values()) + 729
    known = [r["w"] for r in counts.where(F.length("w") > 2).orderBy(F.desc("n"), "w").limit(WORDS).collect()]
    dropped(counts)
    return Prose(tuple(math.log((seen.get(p, 0) + 1) / total * 729) for p in range(729)), tuple(sorted({*known, *DICTIONARY})))


def with_features(found: DataFrame, prose: Prose) -> DataFrame:
    """Adds the forest's features to rows (candidate, before, after)."""
    c, low, n = F.col("candidate"), F.lower("candidate"), F.length("candidate")
    before, after = F.lower("before"), F.lower("after")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "1"), "[^ab1]", "-")
    code = lambda x: F.when((F.ascii(x) >= 97) & (F.ascii(x) <= 122), F.ascii(x) - 97).otherwise(26)
    odds = lambda i: F.get(F.array(*[F.lit(v) for v in prose.pairs]), code(F.substr(low, i, F.lit(1))) * 27 + code(F.substr(low, i + 1, F.lit(1))))
    last_word = F.regexp_extract(before, r"(\S*)$", 1)
    columns = {
        "length": n.cast("double"),
        "turns": _share(F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) - 1, n),
        "digits": _share(F.regexp_count(c, F.lit("[0-9]")), n),
        "upper": _share(F.regexp_count(c, F.lit("[A-Z]")), n),
        "lower": _share(F.regexp_count(c, F.lit("[a-z]")), n),
        "signs": _share(F.regexp_count(c, F.lit("[^A-Za-z0-9]")), n),
        "distinct": _share(F.size(F.array_distinct(F.split(c, ""))), F.least(n, F.lit(40))),
        # mean log odds of its transitions in ordinary text
        "likely": F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), odds), F.lit(0.0), lambda acc, x: acc + x) / F.greatest(n - 1, F.lit(1)),
        "vowels": _share(F.regexp_count(low, F.lit("[aeiou]")), n),
        "covered": _share(n - F.length(F.regexp_replace(low, "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))), "")), n),
        "known": _share(F.aggregate(F.filter(F.split(low, "[^a-z]+"), lambda w: w.isin(list(prose.words))), F.lit(0), lambda acc, w: acc + F.length(w)), n),
        "hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "number": c.rlike("^[0-9]+$").cast("double"),
        "prefix": c.rlike(PREFIXES).cast("double"),
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "dashes": F.regexp_count(c, F.lit("[-_]")).cast("double"),
        "in_path": (last_word.rlike(r"[/\\]|\.$|://") | after.rlike(r"^[/\\.][a-z]")).cast("double"),
        "quoted": before.rlike("[\"'`]$").cast("double"),
        "assigned": before.rlike("[:=]\\s*[\"'`]?$").cast("double"),
        "secret_word": F.right(before, F.lit(30)).rlike(SECRET_WORDS).cast("double"),
        "other_word": F.right(before, F.lit(30)).rlike(OTHER_WORDS).cast("double"),
        "longest_letters": F.array_max(F.transform(F.split(low, "[^a-z]+"), lambda p: F.length(p))).cast("double"),
    }
    return found.withColumns(columns)


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings (candidate, before, after, label), the same at every call.

    Secrets are random strings in the alphabets and places where keys occur;
    the others are what the pattern also finds: digests, identifiers, numbers,
    long words with digits, slugs and paths.
    """
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30))
    choose = lambda k, *x: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]), (draw(k) % len(x) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512)
    base64 = F.base64(F.unhex(digest))
    mixed = F.regexp_replace(base64, "[+/=]", "")
    numbers = F.regexp_replace(F.conv(F.substring(digest, 1, 14), 16, 10), "^", "4")
    words = F.array(*[F.lit(w) for w in DICTIONARY])
    word = lambda k: F.element_at(words, (draw(k) % len(DICTIONARY) + 1).cast("int"))
    syllable = lambda k: choose(k, "an", "er", "th", "re", "in", "on", "ca", "lo", "mi", "tu", "chen", "tion", "eau", "ado")
    prose = F.concat(syllable(30), syllable(31), F.lit(" "), syllable(32), syllable(33), F.lit(" "))
    year = (draw(40) % 30 + 1995).cast("string")
    letters = F.regexp_replace(mixed, "[0-9]", "x")
    spoken = F.concat(word(50), F.substring(F.upper(digest), 1, 3), choose(51, "!", "#", "$", "", "@"), word(52))
    secret = choose(
        1, F.substring(digest, 1, 40), F.substring(digest, 1, 32), F.substring(mixed, 1, 40), F.substring(mixed, 1, 24), F.substring(base64, 1, 44),
        F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.upper(F.substring(digest, 1, 40)),
        F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit("."), F.substring(mixed, 10, 30), F.lit("."), F.substring(mixed, 3, 30)),
        F.substring(letters, 1, 24), F.concat(F.substring(mixed, 1, 6), choose(53, "!", "$", "#", "@9"), F.substring(mixed, 12, 4)), spoken,
        F.concat(syllable(70), syllable(71), (draw(72) % 1000).cast("string"), choose(73, "!", "?x", "#", "!x", "$1", "?")),
    )
    lead = choose(
        2, 'token = "', "token: ", "secret = '", "api_key=", "password: ", 'auth_token="', "AWS_SECRET_ACCESS_KEY=", "Authorization: Bearer ", 'TOKEN = "', 'private key "', "access_key = ", "DB_PASSWORD=", 'pwd = "', "passphrase: ",
    )
    uuid = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    other = choose(
        3, F.substring(digest, 1, 40), F.substring(digest, 1, 64), F.substring(digest, 1, 32), uuid, F.substring(F.concat(numbers, numbers), 1, 16), F.substring(F.concat(numbers, numbers), 1, 24),
        F.concat(word(4), F.lit("-"), word(5), F.lit("-"), word(6), F.lit("-"), year), F.concat(word(4), F.lit("/"), word(5), F.lit("/v2/"), word(6), F.lit("/"), word(7)),
        F.concat(syllable(8), syllable(9), syllable(10), syllable(11), syllable(12), syllable(13), year), F.concat(word(4), F.lit("_"), word(5), F.lit("_"), year, F.lit("_0"), word(6)),
        F.concat(year, F.lit("-01-02T10-20-30_"), word(6)), F.concat(F.lit("XXXXXXXXXXXXXXXX"), year), F.concat(F.lit("example"), word(4), F.lit("12345678")),
    )
    plain = choose(14, "", "commit ", "sha256: ", 'md5 = "', "uuid: ", "order ", "card ", "see ", "file ", "https://example.com/", "path /", "checksum: ", "id ", "and ", "| ")
    # what also stands behind such a lead, and is none
    named_only = choose(
        60, word(61), F.concat(word(61), F.lit("_"), word(62)), F.concat(F.lit("your_"), word(61), F.lit("_here")), F.lit("required"), F.concat(F.lit("${"), F.upper(word(61))), F.concat(F.lit("os.environ["), word(61)),
        F.concat(word(61), F.lit("."), word(62)), F.concat(syllable(63), syllable(64), syllable(65)), F.lit("xxxxxxxxxx"), F.lit("********"), F.concat(F.lit("https://"), word(61), F.lit(".example/"), word(62)), F.lit("undefined"), F.concat(word(61), (draw(74) % 10).cast("string")),
    )
    is_secret = draw(20) % 2 == 0
    led = draw(21) % 3 == 0
    # digests are no secrets only beside words that say what they are
    bare = F.col("other").rlike("^[0-9a-f]{32,64}$")
    rows_ = spark.range(0, rows, 1, 4).select("id", is_secret.alias("is_secret"), secret.alias("secret"), F.when(led, named_only).otherwise(other).alias("other"), lead.alias("lead"), F.when(led, lead).otherwise(plain).alias("plain"), prose.alias("prose"))
    named = choose(15, "commit ", "sha256: ", 'md5 = "', "digest ", "checksum: ", "build ")
    rows_ = rows_.withColumn("plain", F.when(bare, named).otherwise(F.col("plain")))
    return rows_.select(
        F.when(F.col("is_secret"), F.col("secret")).otherwise(F.col("other")).alias("candidate"),
        F.concat("prose", F.when(F.col("is_secret"), F.col("lead")).otherwise(F.col("plain"))).alias("before"),
        F.concat(F.when(F.col("is_secret") & F.col("lead").rlike("[\"']$"), '"').otherwise(""), F.lit(" "), F.col("prose")).alias("after"),
        F.col("is_secret").cast("double").alias("label"),
    )


def train(findings: DataFrame, prose: Prose) -> PipelineModel:
    """A forest over labelled findings (candidate, before, after, label)."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(with_features(findings, prose))


def judged(found: DataFrame, model: PipelineModel, prose: Prose) -> DataFrame:
    """Adds ``probability`` (six decimals) and ``secret`` to rows (candidate, before, after)."""
    out = model.transform(with_features(found, prose)).withColumn("_p", vector_to_array("probability")[1])
    out = out.drop("probability", "features", "rawPrediction", "prediction", *FEATURES)
    return out.withColumn("probability", F.round("_p", 6)).withColumn("secret", F.col("_p") >= THRESHOLD).drop("_p")


def candidates_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, number, start, candidate, before, after) of every candidate in whole texts.

    Texts without a candidate are gone after one search. The text between
    candidates gives their places by running sums of lengths.
    """
    rows = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    cut = rows.select("id", "row", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("between"))
    slim = F.transform("between", lambda t: F.struct(F.length(t).alias("n"), F.right(t, F.lit(NEAR)).alias("end"), F.left(t, F.lit(NEAR)).alias("head")))
    cut = cut.select("id", "row", "c", slim.alias("b")).select(
        "id", "row", F.posexplode(F.arrays_zip(
            F.col("c"), F.slice("b", 1, F.size("c")).alias("left"), F.slice("b", 2, F.size("c")).alias("right"))).alias("number", "x"),
    )
    # a lead belongs to the text before
    lead = F.regexp_extract(F.col("x.c"), f"^(?:{LEAD})?", 0)
    cut = cut.withColumn("lead", lead).select(
        "id", "row", "number", F.substr(F.col("x.c"), F.length("lead") + 1).alias("candidate"), F.col("x.left.n").alias("gap"), F.length("lead").alias("lead"),
        F.right(F.concat("x.left.end", "lead"), F.lit(NEAR)).alias("before"), F.col("x.right.head").alias("after"))
    run = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return cut.select(
        "id", "number", (F.sum(F.col("gap") + F.col("lead") + F.length("candidate")).over(run) - F.length("candidate")).cast("long").alias("start"),
        "candidate", "before", "after",
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: id, start, length, ``candidate_sha256``, probability, ``secret``.

    Starts are code points. Every candidate of whole texts is returned with
    the forest's probability; ``secret`` is true from ``THRESHOLD`` on. The
    forest is trained from ``findings`` (candidate, before, after, label) or
    the built-in ones; features are the candidate's length, transitions
    between its characters as ordinary text has them, dictionary coverage,
    path signs and the words beside it. Ordinary text is learnt from all
    documents. The candidate itself isn't returned.

    Null and empty texts have no candidates and give no row, like an empty
    table. Repeated rows give repeated results, null ids stay null; other
    columns are ignored.
    """
    prose = learn_prose(docs, id_col, text_col)
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession), prose)
    out = judged(candidates_of(docs, id_col, text_col), model, prose)
    return out.select(
        F.col("id").alias(id_col), "start", F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "secret",
    )
