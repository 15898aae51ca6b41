"""Secret scan: patterns propose candidates, a random forest removes false positives.

Candidates, features and scores are built-in column functions. What words and letter transitions are
usual is counted over the whole corpus; the forest is trained once on a bounded table of labelled
findings and then becomes one column expression.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of context on either side.
AROUND = 40
TREES, DEPTH, SEED = 25, 8, 17
#: Labelled findings that the forest is trained on, at most.
TRAIN_FINDINGS = 8000
#: Share of the trees' votes from which a finding counts as a secret.
THRESHOLD = 0.5
#: A word of the dictionary makes up at least this share of the corpus's words (so there are at most
#: 1 / WORD_SHARE of them, at every size) and occurs at least WORD_COUNT times.
WORD_SHARE, WORD_COUNT = 1e-5, 5
#: Characters that are taken apart at once.
PIECE = 1024

#: Words that the dictionary holds besides the corpus's own.
DICTIONARY = (
    "the", "and", "for", "with", "from", "this", "that", "not", "all", "new", "test", "example", "sample", "demo", "your", "here", "change", "default",
    "user", "name", "admin", "local", "host", "server", "client", "service", "config", "data", "base", "file", "path", "home", "main", "index", "image", "page",
    "version", "release", "build", "http", "https", "www", "com", "org", "net", "mail", "node", "module", "class", "function", "value", "object", "string", "number",
    "date", "time", "year", "month", "day", "list", "item", "order", "group", "table", "view", "model", "type", "key", "token", "secret", "password", "pass",
)
SECRET_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|signature)"
_NAMED = SECRET_WORDS[4:]
_SET = _NAMED + r"[\"'`]?\s*+:?[:=]\s*+"
_RUN = r"[A-Za-z0-9_/+.~-]{12,}+(?:={1,2}(?![A-Za-z0-9_/+=.~-]))?"
#: Candidates: a run of key characters behind a secret word and a sign, or any with a digit in it (an inner = ends a
#: run), by possessive repeats so that nothing is tried twice; and, in a scan of its own, all that is quoted there.
_WITH_DIGIT = rf"(?<![A-Za-z0-9_/+.~-])(?=[A-Za-z_/+.~-]*+[0-9]){_RUN}"
RUN = rf"(?i:{_SET})[\"'`]?{_RUN}|{_WITH_DIGIT}"
QUOTED = rf"(?i:{_SET})['\"][^'\"]{{12,}}+(?=['\"])"
#: What stands before the value in a match.
LEAD = rf"^(?i:{_SET})[\"'`]?(?=[^\"'`])"
#: What every text with a candidate holds; most texts are spared the other patterns.
HINT = rf"(?=[A-Ca-cPpSsTt])(?i:{_SET})|{_WITH_DIGIT}"
PLAIN_WORDS = r"(?i)\b(?:sha(?:1|256)?|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|version|phone|card|order|invoice|isbn|id)\b"
PLACEHOLDER = r"(?i)(?:example|sample|placeholder|change_?me|your[_-]|dummy|xxxx|test[_-]|fake|0{6,}|1234567|abcdef0)"
LOGIN = r"(?i)(?:(?:^|\s)-u\s*[\"']?[\w.@-]{1,32}:|://[\w.%+-]{1,32}:|bearer\s+|basic\s+|-p\s*|--pass(?:word)?[= ]|authorization:\s*)$"
TOLD = SECRET_WORDS + r"\s+(?:is|was|are|being)\s*[:=]?\s*[\"'`]?$"
#: What follows a name in code: a call, an index, a member.
CALLED = r"^(?:\(|\[|\.[A-Za-z_])"
KEY_PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ)"
CONFIG_PATH = r"(?i)(?:^|[/_.-])(?:env|conf(?:ig)?|settings|secrets?|credentials?|prod|deploy)(?:[/_.-]|$)"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|specs?|examples?|fixtures?|mocks?|docs?|samples?)(?:[/_.-]|$)"

FEATURES = (
    "length", "digit_share", "upper_share", "class_changes", "letter_runs", "distinct_share", "hex_only", "digits_only", "transitions", "letter_pairs", "dictionary", "vowel_share", "key_prefix",
    "secret_before", "secret_near", "told_before", "login_before", "assigned", "quoted", "plain_before", "plain_after", "placeholder", "test_path", "config_path", "dotted",
    "called_after", "humps",
)


class Usual(NamedTuple):
    """What is usual in a corpus: its frequent words, a staged table (word), and log P(next | letter) of a-z, row by row."""

    words: DataFrame
    letters: list[float]


def learn(docs: DataFrame, text_col: str = "text") -> Usual:
    """Counts the words of all whole texts, then their letter pairs, by grouped aggregation.

    A word is a run of letters, without case, that stands apart from other letters and digits.
    """
    found = F.regexp_extract_all(common.text_or_empty(text_col), F.lit(r"(?<![\p{L}\p{N}])\p{L}{3,}+(?!\p{N})"), F.lit(0))
    counts = docs.select(F.explode(found).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    base = docs.sparkSession.createDataFrame([(w,) for w in DICTIONARY], "word string")
    counts = common.staged(counts, "secret-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = counts.where(F.col("n") >= max(WORD_COUNT, WORD_SHARE * total)).select("word")
    words = common.staged(words.unionByName(base).distinct(), "secret-words")
    plain = counts.where(F.col("word").rlike("^[a-z]+$")).unionByName(base.withColumn("n", F.lit(1).cast("long")))
    pair = F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{2}))"), F.lit(1)))
    pairs = plain.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    got = {r["pair"]: r["n"] for r in pairs.collect()}  # 676 rows at most
    az = "abcdefghijklmnopqrstuvwxyz"
    rows = [[got.get(x + y, 0) + 1 for y in az] for x in az]
    return Usual(words, [math.log(n / sum(row)) for row in rows for n in row])


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _letter_pairs(value: Column, letters: list[float]) -> Column:
    """struct<n, total>: of neighbouring letters, how many there are and their log likelihoods added up."""
    codes, table = F.lit([(x | 32) - 97 if chr(x).isalpha() else 26 for x in range(128)]), F.lit(letters)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("total"))
    add = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["total"] + x["total"]).alias("total"))

    def of(c: Column) -> Column:
        both = F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.when((x < 26) & (y < 26), F.get(table, x * 26 + y)))
        return F.aggregate(both, zero, lambda s, x: F.when(x.isNull(), s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["total"] + x).alias("total"))))

    parts = F.transform(_pieces(value), lambda p: common.let(F.transform(F.split(p, ""), lambda ch: F.coalesce(F.get(codes, F.ascii(ch)), F.lit(26))), of))
    return F.aggregate(parts, zero, add)


def _pieces(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def covered(values: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (digest, letters): of the distinct values (digest, value), how many letters lie in words of the dictionary."""
    part = F.explode(F.regexp_extract_all("value", F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), F.lit(0)))
    parts = values.dropDuplicates(["digest"]).select("digest", part.alias("part")).select("digest", F.lower("part").alias("word"))
    return parts.join(common.sized(words, 40), "word").groupBy("digest").agg(F.sum(F.length("word")).alias("letters"))


def with_features(findings: DataFrame, usual: Usual) -> DataFrame:
    """Staged findings (value, before, after, path, ...) with a column of doubles for each of FEATURES."""
    findings = findings.withColumn("digest", common.digest_of("value"))
    known = common.staged(covered(findings.select("digest", "value"), usual.words), "secret-covered")
    findings = findings.join(common.sized(known, 80), "digest", "left").withColumn("_pairs", _letter_pairs(F.col("value"), usual.letters))
    v, n = F.col("value"), F.length("value").cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    letters = F.greatest(_count(v, "[A-Za-z]"), F.lit(1.0))
    cols = {
        "length": n,
        "digit_share": _count(v, "[0-9]") / n,
        "upper_share": _count(v, "[A-Z]") / letters,
        "class_changes": _count(v, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "letter_runs": _count(v, "[A-Za-z]{4,}") / n,
        "distinct_share": F.size(F.array_distinct(F.flatten(F.transform(_pieces(v), lambda p: F.array_distinct(F.split(p, "")))))) / n,
        "hex_only": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(v.rlike(r"^[0-9.+=/~-]+$")),
        "transitions": F.when(F.col("_pairs.n") > 0, F.col("_pairs.total") / F.col("_pairs.n")).otherwise(-7.0),
        "letter_pairs": F.col("_pairs.n") / n,
        "dictionary": F.coalesce(F.col("letters"), F.lit(0)) / n,
        "vowel_share": _count(v, "[aeiouAEIOU]") / letters,
        "key_prefix": flag(v.rlike(KEY_PREFIX)),
        "secret_before": flag(F.col("before").rlike(SECRET_WORDS + r"[^A-Za-z0-9]{0,8}$")),
        "secret_near": flag(F.col("before").rlike(SECRET_WORDS)),
        "told_before": flag(F.col("before").rlike(TOLD)),
        "login_before": flag(F.col("before").rlike(LOGIN)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "plain_before": flag(F.col("before").rlike(PLAIN_WORDS)),
        "plain_after": flag(F.col("after").rlike(PLAIN_WORDS)),
        "placeholder": flag(v.rlike(PLACEHOLDER)),
        "test_path": flag(F.col("path").rlike(TEST_PATH)),
        "config_path": flag(F.col("path").rlike(CONFIG_PATH)),
        "dotted": flag(v.rlike(r"^[A-Za-z0-9]+(?:[./_-][A-Za-z0-9]+){2,}$")),
        "called_after": flag(F.col("after").rlike(CALLED)),
        "humps": flag(v.rlike(r"^[a-z]{3,}(?:[0-9]{0,2}[A-Z][a-z]{2,})*[0-9]{0,2}(?:[A-Z]?[a-z]{2,})?$")),
    }
    return findings.withColumns(cols).drop("_pairs", "letters")


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of the pattern's values, without what LEAD takes."""
    gaps, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(x: Column, m: Column, i: Column) -> Column:
        def cut(v: Column) -> Column:
            lead = F.concat(F.get(x["gaps"], i), F.left(m, F.length(m) - F.length(v)))
            return F.struct(F.length(lead).alias("gap"), F.right(lead, F.lit(AROUND)).alias("before"), v.alias("value"), F.left(F.coalesce(F.get(x["gaps"], i + 1), F.lit("")), F.lit(AROUND)).alias("after"))

        return common.let(F.regexp_replace(m, LEAD, ""), cut)

    def placed(parts: Column) -> Column:
        at = common.running(F.transform(parts, lambda p: p["gap"] + F.length(p["value"])), lambda a, b: a + b)
        return F.zip_with(parts, at, lambda p, a: F.struct((a + p["gap"]).alias("start"), (a + p["gap"] + F.length(p["value"])).alias("end"), p["value"].alias("value"), p["before"].alias("before"), p["after"].alias("after")))

    return common.let(common.let(F.struct(gaps.alias("gaps"), found.alias("found")), lambda x: F.transform(x["found"], lambda m, i: one(x, m, i))), placed)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Rows (doc_id, path, start, end, value, before, after) of all candidates, in code points."""
    text = common.text_or_empty(text_col)
    runs, quoted = _spans(text, RUN), _spans(text, QUOTED)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.where(text.rlike(HINT)).select(F.col(id_col).alias("doc_id"), path.alias("path"), runs.alias("runs"), quoted.alias("quoted"))
    flagged = lambda name, k: F.transform(name, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(k).alias("again"), r["value"].alias("value"), r["before"].alias("before"), r["after"].alias("after")))

    def once(every: Column) -> Column:  # a quoted value that is a run as well is one candidate
        last = lambda i: F.get(every, F.when(i > 0, i - 1))
        return F.filter(every, lambda s, i: (s["again"] == 0) | ~F.coalesce((last(i)["start"] == s["start"]) & (last(i)["end"] == s["end"]), F.lit(False)))

    rows = rows.select("doc_id", "path", F.explode(common.let(F.array_sort(F.concat(flagged("runs", 0), flagged("quoted", 1))), once)).alias("s"))
    return rows.select("doc_id", "path", "s.start", "s.end", "s.value", "s.before", "s.after")


#: What stands before and after a made finding; every other entry is kept for held-out findings.
SETS = ('token = "', "API_KEY=", 'the password: "', "secret: ", "client_secret := '", "passwd=", 'set access_key = "', "private_key: ", 'const authToken = "', "pwd: ", "?api-key=", 'export SECRET="')
LOGINS = ("curl -u admin:", "login -u bob:", "https://joe:", "ftp://ann:", "Authorization: Bearer ", "header Bearer ", "mysql -p", "psql --password=")
DIGESTS = ("commit ", "see revision ", "sha256:", "sha1 ", "md5 of it ", "checksum ", "etag: ", "uuid=", "version ", "digest ", "the hash ", "order id ")
NEUTRAL = ("see ", "the ", "and ", "\n", "", "with ", "of ", "from ", "at ", "in ")
TELLING = ("the password is ", "my passphrase is: ", 'your password was "', "its secret is ", "the auth token is ", "the pwd was ", "our credentials are ", "the api key is ")
CODE = ("password = ", "const authToken = ", "token = ", "this.secret = ", "api_key: ", "return ", "let accessKey = ", "if secret == ", "auth=", "private_key = ")
ENVIRON = ('os.getenv("', 'environ["', 'config.get("', "process.env.", 'settings["', "${", "ENV['", "System.getenv(\"")
CALLS = ('("DB_PASSWORD")', "(self)", "(request, name)", "[0]", '("token")', ".get(name)", "()", '["key"]')
CLOSES = ('" and', "\n", '"', " of the", "'", ", the", " then")
TELLS = (" is the md5 of the file", " (commit hash)", " is its sha1 checksum", " as the digest says", " the revision", " is a version id")
PATHS = ("src0", "src/app.py", "config/prod.env", "tests/fixtures/a.json", "docs/readme.md", "", "deploy/settings.yml", "web/index.html")
PHRASE = ("correct", "horse", "battery", "staple", "purple", "monkey", "dishwasher", "winter", "tango", "copper", "velvet", "rocket", "lantern", "pepper", "harbor", "willow")
DUMMIES = ("your-api-key-1234567", "example_token_000000", "changeme_secret_1", "xxxxxxxxxxxx1234", "test_password_123", "dummy-key-0000000", "your_token_here_please", "sample-secret-value")


def made_findings(spark: SparkSession, n: int = TRAIN_FINDINGS, seed: int = SEED, held_out: bool = False) -> DataFrame:
    """Labelled findings (value, before, after, path, label) made from a seed.

    Random keys (hexadecimal, base-62, base-64, with a vendor's prefix) are secrets where they are set,
    or used to log in, and no word after says otherwise; vendors' keys are wherever they stand; digests
    and revisions named as such are not, nor is a bare hexadecimal run. Passphrases are secrets where
    they are set, but for natural words below a test path. Identifiers (set ones excepted), versions,
    file and host names, numbers, dates, placeholders and plain words never are, set or not; nor are
    names of code that is called or used there (members and names in camel case). Words with a number
    between them are secrets where a sentence tells that they are the password.
    held_out findings have other contexts, besides other values for another seed.
    """
    d = lambda k: F.sha2(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")), 256)
    roll = lambda k, m: F.pmod(F.xxhash64(F.lit(seed * 31 + k), "id"), F.lit(m))
    pick = lambda k, options: F.get(F.array(*[F.lit(x) for x in options]), roll(k, len(options)).cast("int"))
    half = lambda options: options[1::2] if held_out else options[::2]
    b64 = F.concat(F.base64(F.unhex(d("b"))), F.base64(F.unhex(d("B"))))
    b62 = F.regexp_replace(b64, "[+/=]", "k")
    word = lambda k: pick(k, DICTIONARY)
    size = (20 + roll(1, 21)).cast("int")
    hexes = F.left(d("h"), F.get(F.array(F.lit(32), F.lit(40), F.lit(40), F.lit(64)), roll(2, 4).cast("int")))
    kind, context = roll(3, 25), roll(4, 5)  # contexts: set, login, named digest, neutral, set but told apart after it
    snake = roll(70, 3) == 0
    value = (
        F.when(kind < 5, F.when(roll(5, 6) == 0, F.upper(hexes)).otherwise(hexes))
        .when(kind < 7, F.left(b62, size))
        .when(kind == 7, F.left(b64, size + 8))
        .when(kind.isin(8, 24), F.concat(pick(6, ("AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-", "AIza")), F.left(b62, size)))
        .when(kind == 9, F.concat_ws("-", *[F.translate(F.substr(d("w"), F.lit(1 + 8 * k), F.lit(4 + k)), "0123456789", "ghijklmnop") for k in range(4)]))
        .when(kind.isin(10, 11), F.regexp_replace(F.concat_ws("-", *[pick(40 + k, PHRASE) for k in range(3)]), F.lit("-"), F.when(kind == 10, "-").otherwise("")))
        .when(kind == 12, F.concat_ws("-", F.substr(d("u"), F.lit(1), F.lit(8)), F.substr(d("u"), F.lit(9), F.lit(4)), F.substr(d("u"), F.lit(13), F.lit(4)), F.substr(d("u"), F.lit(17), F.lit(4)), F.substr(d("u"), F.lit(21), F.lit(12))))
        .when(kind == 13, F.concat(word(7), pick(8, ("-", "_", ".")), word(9), pick(10, ("-", "_", ".")), F.lit("v"), roll(11, 30).cast("string"), F.lit(".tar.gz")))
        .when(kind == 14, F.concat(F.lit("4"), F.left(F.conv(F.left(d("n"), F.lit(13)), 16, 10), F.lit(14))))
        .when(kind == 15, pick(11, half(DUMMIES)))
        .when(kind == 16, F.concat(word(12), word(13), word(14), word(15), roll(12, 1000).cast("string")))
        .when(kind == 17, F.concat(word(15), F.lit("."), word(16), roll(13, 100).cast("string"), F.lit(".example.com")))
        .when(kind == 18, F.concat_ws(" ", *[word(20 + k) for k in range(6)]))
        .when(kind == 19, F.concat_ws("-", *[word(30 + k) for k in range(3)], pick(17, ("service", "server", "config"))))
        .when(kind == 21, F.concat_ws(".", word(50), pick(51, ("environ", "headers", "settings", "config", "session", "request")), pick(52, ("get", "getenv", "get_token", "password", "load", "secret"))))
        .when((kind == 22) & snake, F.concat_ws("_", F.upper(word(68)), pick(69, ("PASSWORD", "TOKEN", "SECRET", "API_KEY", "CREDENTIAL")), F.when(roll(72, 2) == 0, roll(73, 10).cast("string"))))
        .when(kind == 22, F.concat(word(53), F.initcap(word(54)), F.when(roll(55, 2) == 0, roll(56, 10).cast("string")).otherwise(""), F.initcap(word(57)), roll(58, 3).cast("string"), F.when(roll(59, 2) == 0, word(60)).otherwise("")))
        .when(kind == 23, F.concat(pick(61, PHRASE), (10 + roll(62, 90)).cast("string"), pick(63, PHRASE)))
        .otherwise(F.concat_ws("-", F.lit("2024"), F.lpad(roll(14, 12).cast("string"), 2, "0"), F.lpad(roll(15, 28).cast("string"), 2, "0"), word(17), word(18)))
    )
    # base-62, base-64 and passphrases in a neutral place say neither, so they are always set
    context = F.when(kind.isin(5, 6, 7) & (context == 3), 0).when(kind.between(9, 11) & context.isin(1, 2, 3), 0).otherwise(context)
    path = pick(19, PATHS)
    used = context.isin(0, 1)
    label = F.when(kind < 8, used).when(kind.isin(8, 24), ~context.isin(2, 4)).when(kind == 9, context == 0).when(kind < 12, (context == 0) & ~path.rlike(TEST_PATH)).when(kind == 12, context == 0).when(kind == 23, (context < 3) & ~path.rlike(TEST_PATH)).otherwise(F.lit(False))
    sets = pick(20, half(SETS))
    before = F.when(context.isin(0, 4), sets).when(context == 1, pick(21, half(LOGINS))).when(context == 2, pick(22, half(DIGESTS))).otherwise(pick(23, half(NEUTRAL)))
    before = F.when((kind == 22) & snake, pick(71, half(ENVIRON))).when(kind.isin(21, 22), pick(64, half(CODE))).when((kind == 23) & (context < 3), pick(65, half(TELLING))).otherwise(before)
    # a quotation that the context opens is closed
    opened = F.regexp_extract(before, "[\"']$", 0)
    after = F.when(context == 4, F.concat(opened, pick(24, half(TELLS)))).when(opened != "", F.concat(opened, pick(25, (" and", "\n", ";")))).otherwise(pick(26, half(CLOSES)))
    after = F.when((kind == 21) | ((kind == 22) & ~snake & (context < 3)), pick(66, half(CALLS))).when(kind == 22, F.concat(opened, pick(67, (";", "\n", ",", ")")))).otherwise(after)
    return spark.range(n).select(value.alias("value"), F.concat(pick(27, ("", "so ", "and now ", "x: 1\n")), before).alias("before"), after.alias("after"), path.alias("path"), label.cast("double").alias("label"))


def _rule(lines: list[str], at: int, depth: int, names: tuple[str, ...]) -> tuple[Column, int]:
    """The column of a printed tree's node whose lines begin at `at`, and the line after it."""
    line = lines[at]
    if leaf := re.search(r"Predict: ([\d.Ee+-]+)", line):
        return F.lit(float(leaf[1])), at + 1
    m = re.search(r"If \(feature (\d+) <= ([\d.Ee+-]+)\)", line)
    yes, at = _rule(lines, at + 1, depth + 1, names)
    no, at = _rule(lines, at + 1, depth + 1, names)  # skips the Else line
    return F.when(F.col(names[int(m[1])]) <= float(m[2]), yes).otherwise(no), at


def train_forest(findings: DataFrame, usual: Usual, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most: int = TRAIN_FINDINGS) -> Column:
    """The share of a forest's trees that call a row with FEATURES a secret, as a column.

    findings (value, before, after, path, label) are cut to `most` rows by a seeded order. One kind
    of label, or no findings, gives a constant.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    some = findings.where("value is not null and label is not null").na.fill("", ["before", "after", "path"])
    some = some.orderBy(F.xxhash64(F.lit(seed), "value", "before"), "value", "before", "after", "path", "label").limit(most)
    rows = common.staged(with_features(common.staged(some, "secret-findings"), usual).coalesce(1), "secret-train")
    kinds = [r["label"] for r in rows.select("label").distinct().limit(3).collect()]
    if len(kinds) < 2:
        return F.lit(kinds[0] if kinds else 0.0)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "label").coalesce(1)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(ready)
    votes = []
    for tree in model.trees:
        lines = [x for x in tree.toDebugString.splitlines() if "Predict" in x or "If " in x or "Else" in x]
        votes.append(_rule(lines, 0, 0, FEATURES)[0])
    return sum(votes[1:], votes[0]) / float(len(votes))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, start, end, value_sha256, score, secret), one per candidate.

    start and end count code points, end exclusive. The forest is trained on findings, or else on
    made_findings. Null and empty texts have no candidates; repeated rows give repeated findings;
    null paths and ids are allowed; extra columns are ignored. Findings of one label only, or none,
    give every candidate that label's score, or 0.
    """
    usual = learn(docs, text_col)
    score = train_forest(findings if findings is not None else made_findings(docs.sparkSession), usual)
    rows = with_features(common.staged(candidates(docs, id_col, text_col, path_col), "secret-candidates"), usual)
    out = rows.select("doc_id", "start", "end", F.lower(F.hex("digest")).alias("value_sha256"), F.round(score, 6).alias("score"))
    return out.withColumn("secret", F.col("score") >= threshold)
