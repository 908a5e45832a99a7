"""Secret scan: candidates by pattern, false positives removed by a random forest (DataFrame functions only).

A candidate is a maximal run of at least ``LEAST`` key characters with a digit, or any non-blank or
quoted value after a secret-like name with ``=`` or ``:``.  The
text between candidates is kept next to it, so a finding's place and its neighbours are known
without a second look at the text.  Inputs of the forest are the candidate's
length, character shares and transitions, how much of it dictionary pieces cover, path
signs, known key starts, and the words beside it.

The forest is trained by ``pyspark.ml`` on a bounded table of labelled findings and then
written out as one column expression per tree, so scanning and redacting are
one map over the documents: no explode, no shuffle, no group.
"""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, running_sum

LEAST = 12
CONTEXT = 40
REPLACEMENT = "[SECRET]"
MAX_LABELLED = 20_000
MAX_TREES = 64
# Words beside a candidate that speak for or against a secret, key starts, dictionary pieces: fixed values.
FOR_WORDS = "token|secret|passw|passwd|pwd|(?<![a-z])pw(?![a-z])|passphrase|api.?key|access.?key|private.?key|auth|bearer|credential|client.?secret"
AGAINST_WORDS = "commit|revision|sha1|sha256|sha512|md5|checksum|digest|etag|uuid|guid|isbn|order|invoice|card|phone|tel|version|build|file|image|page"
KEY_STARTS = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29|eyJ"
# Key characters; '=' is padding only at the end of a value.
KEY = r"[A-Za-z0-9+/_\-]"
# A name is a word (or two, as in 'api key') with a secret-like part, followed by a mark.  The first look-ahead spares words without a mark the second.
PAIR = r"(?:[^\w\r\n](?i:key|secret)[\w.\-]*+)?+"
MARK = r"[\"'`\])]*+[ \t]*+(?::=|=>|={1,2}|:)[ \t]*+"
NAME = rf"(?<![\w.\-])(?=[\w.\-]++{PAIR}[\"'`\])]*+[ \t]*+[=:])(?=[\w.\-]*?(?i:{FOR_WORDS}))[\w.\-]++{PAIR}"
RUN = (
    rf"(?<!{KEY})(?=[A-Za-z+/_\-]*+[0-9])(?!{KEY}*?(?i:{FOR_WORDS})[\w.\-]*+{MARK}[^\s]){KEY}{{{LEAST},}}+"
    r"(?:={1,2}(?=[\"'`]?(?:[\s,;.)\]}&<]|$)))?"
)
# Values: in closed quotes with any escapes, or up to a blank or quote and no name themselves.
INSIDE = {q: rf"(?!{q})[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+)*+" for q in "\"'`"}
BARE = rf"(?!{NAME}{MARK}[^\s])[^\s\"'`]*[^\s\"'`,;.:)\]}}>]"
QUOTE = "|".join(rf"{q}(?={inside}{q})" for q, inside in INSIDE.items())
VALUE = "|".join(rf"(?<={q}){inside}(?={q})" for q, inside in INSIDE.items()) + f"|{BARE}"
# Group 1 is what stands ahead of a value: name, mark, quote or scheme; it is empty for a run.
CANDIDATE = rf"({NAME}{MARK}(?:{QUOTE}|[\"'`]?+(?:(?i:bearer|basic|token)[ \t]++)?+))(?:{VALUE})|{RUN}"
# Candidates before one that its context may reach over: a value and its name have four characters at least.
REACH = CONTEXT // 4
PIECES = (
    "ation|ment|ness|able|ible|ing|tion|sion|the|and|for|with|from|this|that|file|data|user|test|name|list|page|home|main|image|index|report|final|draft|"
    "version|build|order|number|photo|music|video|local|share|public|static|assets|content|article|news|blog|post|date|time|year|month|week"
)

FEATURES = (
    "length", "digits", "upper", "lower", "hex_only", "digits_only", "transitions", "distinct", "covered", "path", "key_start", "for_word", "against_word", "assigned", "quoted",
    "symbols", "word", "filler", "names",
)


def features(candidate: Column, before: Column, after: Column) -> list[Column]:
    """The forest's inputs, in the order of ``FEATURES``."""
    n = F.length(candidate).cast("double")
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    share = lambda kind: F.regexp_count(candidate, F.lit(kind)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    changes = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[+/_\-])"
    left = F.regexp_replace(F.lower(candidate), PIECES, "")
    # only the words right beside the candidate count: the tail after the last sentence end or line break
    tail = F.regexp_extract(near, r"([^.\n]*)$", 1)
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        flag(candidate.rlike("^[0-9a-f]+$") | candidate.rlike("^[0-9A-F]+$")),
        flag(candidate.rlike(r"^[0-9+/_\-]+$")),
        F.regexp_count(candidate, F.lit(changes)) / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(64.0)),
        1 - F.length(left) / n,
        flag((F.regexp_count(candidate, F.lit("/")) > 1) | before.rlike(r"[/\\.]$") | after.rlike(r"^[/\\.][A-Za-z]")),
        flag(candidate.rlike(f"^({KEY_STARTS})")),
        flag(tail.rlike(rf"({FOR_WORDS})\W*(\w+\W+)?$")),
        flag(tail.rlike(rf"\b({AGAINST_WORDS})\b\W*(\w+\W+)?$")),
        flag(near.rlike(r"[=:]\s*[\"'`]?$")),
        flag(near.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        share(r"[^\p{L}0-9+/_\-=\s]"),
        flag(candidate.rlike(r"^\p{L}+$")),
        flag(candidate.rlike(r"(?i)^(none|null|nil|true|false|str|string|text|required|optional|undefined|yes|no)$|^[$<{%]|^[*x.]+$|[\[(]")),
        flag(after.rlike(r"^[ \t]{0,2}[=:]")),
    ]


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 11) -> DataFrame:
    """Findings with labels to train on when no reviewed ones are given: made-up keys and look-alikes in made-up text."""
    r = random.Random(seed)
    digits, lower, upper, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: pick(lower + "éñü", r.randint(2, 9))
    words = lambda k: " ".join(word() for _ in range(k))
    names = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "Authorization: Bearer", "credential")
    marks = (' = "', "=", ": ", "='", '="', ":")
    others = ("commit", "revision", "sha256", "md5", "checksum", "digest", "uuid", "isbn", "order", "invoice", "card", "phone", "version", "build", "file", "image")
    slug = ("report", "final", "image", "photo", "music", "article", "version", "build", "index", "static", "content")

    def key() -> str:
        kind = r.randrange(5)
        if kind == 0:
            return pick(hexa, r.choice((16, 18, 20, 24, 32, 40, 64)))
        if kind == 1:
            return pick(lower + upper + digits, r.randint(14, 48)) + pick(digits, 1)
        if kind == 2:
            return pick(lower + upper + digits + "+/", 38) + "1="
        if kind == 3:
            return pick(lower + digits, r.randint(12, 24)) + pick(digits, 2)
        return pick(hexa.upper(), r.choice((24, 32, 40)))

    def started() -> str:
        start, letters, k = r.choice(
            (
                ("AKIA", upper + digits, 16),
                ("ASIA", upper + digits, 16),
                ("ghp_", lower + upper + digits, 36),
                ("glpat-", lower + upper + digits, 20),
                ("sk_live_", lower + upper + digits, 24),
                ("sk-", lower + upper + digits, 45),
                ("xoxb-", digits, 12),
                ("AIza", lower + upper + digits + "_-", 35),
                ("eyJ", lower + upper + digits + "_-", 60),
            )
        )
        return start + pick(letters, k - 1) + pick(digits, 1)

    def harmless() -> str:
        kind = r.randrange(6)
        if kind == 0:
            return pick(digits, r.choice((12, 13, 16, 16, 16, 19)))
        if kind == 1:
            return "-".join(pick(digits, r.randint(2, 5)) for _ in range(4))
        if kind == 2:
            return "-".join((pick(hexa, 8), pick(hexa, 4), pick(hexa, 4), pick(hexa, 4), pick(hexa, 12)))
        if kind == 3:
            return r.choice("-_").join((r.choice(slug), r.choice(slug), word().encode("ascii", "ignore").decode() or "a", pick(digits, r.randint(1, 4))))
        if kind == 4:
            return "/".join((r.choice(slug), r.choice(slug), r.choice(slug) + pick(digits, 2)))
        return r.choice(slug) + r.choice(slug) + pick(digits, r.randint(1, 4))

    def chosen() -> str:
        kind = r.randrange(5)
        plain = lambda a, b: pick(lower, r.randint(a, b))
        if kind == 0:
            return r.choice("-_.").join(plain(3, 8) for _ in range(r.randint(2, 4)))
        if kind == 1:
            return pick(lower + upper, r.randint(8, 48))
        if kind == 2:
            return pick(upper, 1) + pick("@$!", 1) + pick(lower + digits, r.randint(3, 8)) + pick("!#%&*?", 1) + pick(digits, r.randint(1, 4)) + pick("!#" + lower + digits, r.randint(0, 3))
        if kind == 3:
            return plain(3, 8) + pick(digits, r.randint(1, 4)) + plain(0, 4)
        return plain(3, 8) + pick("!@#$%^&*", r.randint(1, 2)) + plain(2, 8)

    def filler() -> str:
        fixed = ("None", "null", "true", "false", "string", "required", "<password>", "${PASSWORD}", "os.environ[", "getpass()", "****", "{{ token }}", "xxxx", "optional")
        return r.choice(fixed)

    rows = []
    for _ in range(n):
        kind = r.randrange(11)
        lead = words(r.randint(0, 5)) + " "
        if kind < 3:
            mark = r.choice(marks)
            quote = mark[-1] if mark[-1] in "\"'" else ""
            rows.append((lead + r.choice(names) + mark, key(), (quote or r.choice(" ,\n;")) + " " + word(), 1))
        elif kind == 3:
            rows.append((lead + r.choice(("", "key ", "(", '"', "id=")), started(), r.choice(" .,\n)") + word(), 1))
        elif kind == 4:
            rows.append((lead + r.choice(others) + r.choice((" ", ": ", "=", " # ")), r.choice((pick(hexa, 40), pick(hexa, 32), pick(hexa, 64), harmless())), " " + word(), 0))
        elif kind == 5:
            rows.append((lead + r.choice(("", "http://", "see ", "/", "a/")), harmless(), r.choice((".html", " ", "/", ".jpg", ",")) + word(), 0))
        elif kind == 8:
            mark = r.choice(marks)
            quote = mark[-1] if mark[-1] in "\"'" else ""
            value = " ".join((word(), word(), word())) if quote and r.randrange(5) == 0 else word() if quote and r.randrange(6) == 0 else chosen()
            rows.append((lead + r.choice((*names[:-2], "pw", "DB_PASSWORD_2024")) + mark, value, (quote or r.choice(" ,\n;")) + " " + word(), 1))
        elif kind == 9:
            mark = r.choice((": ", ":", " = ", "="))
            value = word() if mark[0] == ":" and r.randrange(2) else filler()
            rows.append((lead + r.choice((*names[:-2], "pw")) + mark, value, r.choice((" ", ",", ".", "\n", ")")) + word(), 0))
        elif kind == 10:
            name = "_".join((word().encode("ascii", "ignore").decode() or "a", r.choice(("password", "token", "secret", "key", "value")), pick(digits, r.randint(1, 4))))
            rows.append((lead, r.choice((name, name.upper())), r.choice(("=", " = ", ":", ": ", '="')), 0))
        else:
            rows.append((lead, harmless(), r.choice(" .,\n") + word(), 0))
    return spark.createDataFrame(rows, "before string, candidate string, after string, label int")


def train(findings: DataFrame, trees: int = 25, depth: int = 7) -> RandomForestClassificationModel:
    """Forest over at most ``MAX_LABELLED`` labelled findings (``before``, ``candidate``, ``after``, ``label``).

    Rows with a null candidate, an empty candidate or a null label are left out; null neighbours are empty.
    """
    if not 1 <= trees <= MAX_TREES:
        raise ValueError("too many trees for an expression")
    rows = findings.where("length(candidate) > 0 and label is not null").orderBy(F.xxhash64("candidate", "before"), "label").limit(MAX_LABELLED)
    inputs = features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    table = rows.select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(n) for c, n in zip(inputs, FEATURES, strict=True)])
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).select("label", "features").coalesce(2)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, maxBins=64).fit(table)


def forest_score(model: RandomForestClassificationModel, inputs: list[Column]) -> Column:
    """Share of the trees that call a candidate a secret, as an expression of its inputs."""
    lines = [line.strip() for line in model.toDebugString.split("\n")]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if leaf := re.match(r"Predict: ([0-9.]+)", line):
            return F.lit(float(leaf[1]))
        rule = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        if rule is None:
            raise ValueError(f"unexpected tree line {line!r}")
        yes = node()
        at += 1  # the matching Else line
        no = node()
        return F.when(inputs[int(rule[1])] <= float(rule[2]), yes).otherwise(no)

    trees = []
    while at < len(lines):
        if lines[at].startswith(("If", "Predict")):
            trees.append(node())
        else:
            at += 1
    return reduce(lambda a, b: a + b, trees) / len(trees)


def _scored(text: Column, model: RandomForestClassificationModel) -> Column:
    """``pieces`` between the candidates and ``found``: each candidate with start, length and score; null without candidates."""

    def before(found: Column, pieces: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), i - REACH)
        told = F.zip_with(F.slice(pieces, first, i - first), F.slice(found, first, i - first), lambda p, c: F.concat(F.right(p, F.lit(CONTEXT)), F.right(c, F.lit(CONTEXT))))
        return F.right(F.concat(F.array_join(told, ""), F.right(F.element_at(pieces, i), F.lit(CONTEXT))), F.lit(CONTEXT))

    def rows(found: Column, pieces: Column) -> Column:
        inputs = F.transform(
            F.sequence(F.lit(1), F.size(found)),
            lambda i: let(
                F.struct(F.element_at(found, i).alias("c"), before(found, pieces, i).alias("b"), F.substring(F.element_at(pieces, i + 1), 1, 8).alias("a")),
                lambda x: F.array(*[c.cast("double") for c in features(x["c"], x["b"], x["a"])]),
            ),
        )
        score = F.transform(inputs, lambda x: forest_score(model, [F.element_at(x, i + 1) for i in range(len(FEATURES))]))
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, c: F.length(p).cast("long") + F.length(c))
        item = lambda scores, before: F.transform(
            found, lambda c, i: F.struct((F.get(before, i) + F.length(F.get(pieces, i))).alias("start"), F.length(c).cast("long").alias("length"), c.alias("secret"), F.get(scores, i).alias("score"))
        )
        return let(score, lambda s: let(running_sum(steps), lambda b: item(s, b)))

    def whole(met: Column) -> Column:
        told = lambda found, pieces: F.struct(pieces.alias("pieces"), rows(found, pieces).alias("found"))
        value = lambda lead: F.zip_with(met, lead, lambda m, ahead: F.substr(m, F.length(ahead) + 1))
        between = lambda lead: F.zip_with(F.split(text, CANDIDATE, -1), lead, lambda p, ahead: F.concat(p, F.coalesce(ahead, F.lit(""))))
        split = lambda lead: let(value(lead), lambda found: let(between(lead), lambda pieces: told(found, pieces)))
        return F.when(F.size(met) > 0, let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)), split))

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), whole)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """One row per confirmed secret: ``doc_id``, ``start``, ``length``, ``secret``, ``score``.

    ``start`` counts characters from 0 in the whole text.  Null and empty texts have no
    findings; repeated rows give repeated findings; other columns are ignored.
    """
    hits = let(_scored(F.col("text"), model), lambda s: F.filter(s["found"], lambda f: f["score"] >= threshold))
    return docs.select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.start", "f.length", "f.secret", "f.score")


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``REPLACEMENT``; ``n_chars``, if there, follows the new text."""
    said = lambda s: F.transform(s["found"], lambda f: F.when(f["score"] >= threshold, F.lit(REPLACEMENT)).otherwise(f["secret"]))
    parts = lambda s: F.zip_with(s["pieces"], said(s), lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    text = F.coalesce(let(_scored(F.col("text"), model), lambda s: F.array_join(parts(s), "")), F.col("text"))
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast("long"), F.col("n_chars"))))
    return out.select(*docs.columns)
