"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

A candidate is a run of characters [A-Za-z0-9+/_-] (and = at its end) inside a word: of at least LEAST with a digit or a known prefix, or of at
least SHORT where an assignment or a key word is before it. Values of key words that other characters break are candidates as a whole as well. Tokens of parts that dots join (eyJ..., SG....) are one candidate; letters
whose case changes four times need no digit. A word has as many candidates as it holds. Their features are length, shares of character
kinds, transitions between kinds and between letters, coverage by dictionary words, signs of a path or address around it, and what the own prefix in the word and the words before
are. The dictionary is the corpus' own: the DICTIONARY_WORDS words of letters that most documents hold, beside a few fixed ones; pieces of letters in a candidate
are looked up in it, and how its letters follow each other is scored by the dictionary's letter pairs. The forest is grown on the driver from labelled findings (a fixed number, made by a seeded generator of true secrets and of what is
mistaken for them; other labelled findings can be passed), whose features come from the same expressions. Trees become literal arrays that a
higher-order function walks, so scoring stays in the plan.

Defined cases: null and empty texts have no findings; a text's findings are numbered by their word; repeated rows have findings of
their own; runs of any length are judged whole, by at most NEAR pieces and SIDE characters of their word on either side. Findings carry a hash, not the secret.
"""

from __future__ import annotations

import hashlib
import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, SHORT, THRESHOLD, TREES, DEPTH = 16, 6, 0.5, 25, 7
#: Words of the dictionary, letters of its shortest and longest ones.
DICTIONARY_WORDS, WORD_LEAST, WORD_MOST = 4096, 4, 20
#: Characters of a run; a word's pieces: runs (with padding) and what is between; delimiters of a part; pieces and characters near a run.
RUN = "A-Za-z0-9+/_-"
PIECES = rf"(?:eyJ[{RUN}]+|SG\.[{RUN}]+)(?:\.[{RUN}]+){{1,2}}|[{RUN}]+(?:=+(?![={RUN}]))?|[^{RUN}]+"
#: Letters whose case changes often, as in a key without digits; what comes before the data of a data URL.
MIXED, DATA_URL = "(?:[a-z]+[A-Z]+){4}", r"(?i)base64,$"
ENDS = r"""\s,;&?="'`{}<>()\[\]|\\"""
NEAR, SIDE = 16, 256
#: Words that name secrets, words that name other things, words of placeholders and addresses.
KNOWN = r"(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[baprs]-|sk_live_|rk_live_|AIza|eyJ|npm_|SG)"
KEYS = r"(?i)(passw|passwd|pwd|secret|token|api.?key|apikey|access.?key|auth|credential|bearer|private.?key)"
#: What may stand between a key word and its value; text that ends with a key word and no value yet; a key word, quote and value inside a word.
QUOTES, FILLERS = r"""\"'`\\""", ("is", "was", "for", "of")
FOLLOWS = rf"{KEYS}[\w.-]{{0,64}}[{QUOTES}]*( ?[=:]+>?)?( ({'|'.join(FILLERS)}))?$"
VALUES = rf"({KEYS}[\w.-]{{0,64}}[{QUOTES}]*+[=:]++>?)([{QUOTES}]*+)((?<=[{QUOTES}])[^{QUOTES}]+|(?<![{QUOTES}])[^\s{QUOTES},;&<>{{}}]+)"
OTHERS = r"(?i)(sha\d*|md5|hash|checksum|digest|commit|uuid|guid|etag|example|sample|dummy|test|placeholder|isbn|order|invoice|card|phone|version|id)\W*$"
COMMON = (
    "example", "sample", "test", "dummy", "placeholder", "changeme", "your", "here", "user", "name", "page", "image", "index", "article", "section", "chapter", "version", "release", "build", "report",
    "item", "order", "number", "date", "time", "data", "file", "main", "home", "news", "post", "blog", "view", "list", "this", "that", "with", "from", "have", "will", "what", "when", "there", "their", "password", "token", "secret",
)
FEATURES = ("length", "digits", "lowers", "uppers", "others", "turns", "pairs", "hexes", "repeats", "covered", "path", "address", "key_inside", "key_before", "other_before", "quoted", "assigned", "known_prefix", "dashes")


def _share(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)).cast("double") / F.greatest(F.length(x), F.lit(1))


class Dictionary:
    """Words, and how likely a letter follows another in them: natural logarithms of 26 x 26 shares, with one more of each."""

    def __init__(self, words: list[str]):
        self.words = sorted({*words, *COMMON})
        counts = np.ones((26, 26))
        for w in self.words:
            codes = [ord(c) - 97 for c in w if "a" <= c <= "z"]
            for a, b in zip(codes, codes[1:], strict=False):
                counts[a, b] += 1
        self.pairs = np.log(counts / counts.sum(1, keepdims=True)).ravel().tolist()

    def pairs_of(self, c: Column) -> Column:
        """The mean over the candidate's neighbouring letters; 0 where there are none."""
        low = F.lower(c)
        code = lambda i: F.ascii(F.substring(low, i, F.lit(1))) - 97
        inside = lambda x: (x >= 0) & (x < 26)
        value = lambda i: F.when(inside(code(i)) & inside(code(i + 1)), F.get(F.lit(self.pairs), code(i) * 26 + code(i + 1)))
        found = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), value), lambda x: x.isNotNull())
        return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found)).otherwise(0.0)

    def covered(self, c: Column) -> Column:
        """The share of the candidate's characters that lie in pieces of letters that the dictionary has, or that begin with one of its longest."""
        pieces = F.regexp_extract_all(c, F.lit(f"[A-Z]?[a-z]{{{WORD_LEAST - 1},}}|[A-Z]{{{WORD_LEAST},}}|[a-z]{{{WORD_LEAST},}}"), F.lit(0))
        known = F.filter(pieces, lambda p: F.lower(p).isin(self.words))
        return F.aggregate(known, F.lit(0), lambda s, p: s + F.length(p)).cast("double") / F.greatest(F.length(c), F.lit(1))


def dictionary_of(docs: DataFrame, most: int = DICTIONARY_WORDS) -> Dictionary:
    """The words of letters a to z that most documents hold, counted over whole texts; ties by the word. A text's distinct words are counted, combined before the shuffle."""
    pattern = rf"(?<![A-Za-z0-9_/+=-])[A-Za-z]?[a-z]{{{WORD_LEAST - 1},{WORD_MOST - 1}}}(?![A-Za-z0-9_/+=-])"
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern), F.lit(0)), lambda w: F.lower(w)))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return Dictionary([r["word"] for r in top.select("word").collect()])


def candidates(docs: DataFrame, known: Dictionary) -> DataFrame:
    """doc_id, word (its number), candidate, and the features; one row for each plausible run or value of a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.split(text, r"[\x20\x09-\x0D]+").alias("w"))
    around = lambda i, n: F.coalesce(F.get(F.col("w"), i + n), F.lit(""))
    #: Words that may hold a plausible run or an assignment, or that follow one or a key word.
    after = lambda i: around(i, -1).rlike(f"[=:>]$|{KEYS}") | (around(i, -1).isin(*FILLERS) & around(i, -2).rlike(KEYS))
    fits = lambda x, i: (F.length(x) >= SHORT) & (x.rlike(rf"[=:].*\S{{{SHORT}}}") | (x.rlike(f"[={RUN}]{{{LEAST}}}") & x.rlike(f"[0-9]|{KNOWN}|{MIXED}")) | after(i))
    rows = rows.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(fits(x, i), i)), lambda i: i.isNotNull()))
    found = F.transform("at", lambda i: F.struct(i.alias("word"), F.get(F.col("w"), i).alias("whole"), F.concat_ws(" ", around(i, -3), around(i, -2), around(i, -1)).alias("before")))
    rows = rows.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
    #: A word in pieces, runs and what lies between them; what is near a run is bounded, so that long words take no square of time.
    rows = rows.withColumn("follows", F.col("before").rlike(FOLLOWS)).withColumn("p", F.regexp_extract_all("whole", F.lit(PIECES), F.lit(0)))
    lead = lambda i, n: F.array_join(F.slice("p", F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))), "")
    tail = lambda i: F.array_join(F.slice("p", i + 2, F.lit(NEAR)), "")
    valued = lambda x, i: ~x.rlike(f"^//|^{KEYS}[a-z]*$") & (((i <= 1) & (F.col("follows") | F.col("before").rlike("[=:]>?$"))) | lead(i, 2).rlike(f"[=:]>?[{QUOTES}]*$"))
    plausible = lambda x, i: x.rlike(rf"^([{RUN}]{{{SHORT}}}|SG\.)") & (((F.length(x) >= LEAST) & x.rlike(f"[0-9]|^{KNOWN}|{MIXED}")) | valued(x, i))
    rows = rows.withColumn("at", F.filter(F.transform("p", lambda x, i: F.when(plausible(x, i), i)), lambda i: i.isNotNull()))
    runs = F.transform("at", lambda i: F.struct(F.get(F.col("p"), i).alias("candidate"), F.right(lead(i, NEAR), F.lit(SIDE)).alias("lead"), F.left(tail(i), F.lit(SIDE)).alias("tail")))
    #: Values of key words that hold other characters: in quotes up to the next quote, else up to a delimiter; or the word after a key word.
    ends = F.lit(".,;:)]}>\"'`")
    groups = [F.regexp_extract_all("whole", F.lit(VALUES), F.lit(k)).alias(n) for k, n in ((1, "key"), (3, "quote"), (4, "value"))]
    broken = F.transform(F.arrays_zip(*groups), lambda v: F.struct(F.when(v["quote"] == "", F.rtrim(v["value"], ends)).otherwise(v["value"]).alias("candidate"), F.concat(v["key"], v["quote"]).alias("lead"), v["quote"].alias("tail")))
    quote = F.regexp_extract("whole", f"^[{QUOTES}]*", 0)
    own = F.when(quote == "", F.rtrim("whole", ends)).otherwise(F.regexp_extract("whole", f"^[{QUOTES}]*([^{QUOTES}]*)", 1))
    own = F.array(F.struct(own.alias("candidate"), quote.alias("lead"), quote.alias("tail")))
    broken = F.concat(broken, F.filter(own, lambda v: F.col("follows") & ~F.col("whole").rlike(f"{KEYS}|://") & (v["candidate"].rlike("[0-9]") | F.col("before").rlike("[=:]>?$"))))
    broken = F.filter(broken, lambda v: (F.length(v["candidate"]) >= SHORT) & ~v["candidate"].rlike(f"^[{RUN}]+=*$") & v["candidate"].rlike(r"\w"))
    rows = rows.select("doc_id", "word", "before", F.explode(F.concat(runs, broken)).alias("f")).select("doc_id", "word", "before", "f.*")
    #: A run's own prefix begins after the last field of the word, its part lies between delimiters.
    rows = rows.withColumn("whole", F.concat(F.regexp_extract("lead", rf"[^{ENDS}]*$", 0), "candidate", F.regexp_extract("tail", rf"^[^{ENDS}]*", 0)))
    rows = rows.withColumn("in_data", F.col("lead").rlike(DATA_URL)).withColumn("lead", F.regexp_extract("lead", r"[^,;&?{}|]*$", 0))
    c, whole, before, lead = F.col("candidate"), F.col("whole"), F.col("before"), F.col("lead")
    named = lead.rlike("[A-Za-z0-9_][\"'`\\\\]*[=:]")  # the prefix has a name of its own
    flag = lambda x: x.cast("double")
    values = {
        "length": F.length(c).cast("double"),
        "digits": _share(c, "[0-9]"),
        "lowers": _share(c, "[a-z]"),
        "uppers": _share(c, "[A-Z]"),
        "others": _share(c, "[^A-Za-z0-9]"),
        "turns": _share(c, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"),
        "pairs": known.pairs_of(c),
        "hexes": _share(c, "[0-9a-f]"),
        "repeats": _share(c, r"(.)(?=\1)"),
        "covered": known.covered(c),
        "path": flag(F.col("in_data") | whole.rlike(r"(?i)^(\.{0,2}/|[a-z]:\\)|/.*/|\.(html?|php|js|css|png|jpe?g|gif|pdf|json|xml|txt|zip|gz|py|java)\b|:[0-9]+/")),
        "address": flag(whole.rlike(r"(?i)://|www\.|@[a-z0-9.-]+\.[a-z]{2,}")),
        "key_inside": flag(lead.rlike(KEYS)),
        "key_before": flag(before.rlike(KEYS) & ~named),
        "other_before": flag(F.concat_ws(" ", before, lead).rlike(OTHERS)),
        "quoted": flag(lead.rlike("[\"'`]$") | F.col("tail").rlike("^[\"'`\\\\]")),
        "assigned": flag(lead.rlike("[=:][\"'`\\\\]*$") | (before.rlike("(=|:|=>)$") & ~lead.rlike(r"\w"))),
        "known_prefix": flag(c.rlike(f"^{KNOWN}")),
        "dashes": _share(c, "-"),
    }
    return rows.select("doc_id", F.col("word").cast("long").alias("word"), "candidate", F.array(*(values[k] for k in FEATURES)).alias("features"))


def made_findings(words: list[str], n: int = 3600, seed: int = 7) -> list[tuple[int, str, int]]:
    """(number, text with one candidate, 1 for a secret): labelled findings of many kinds and lengths in prose of the words, and of invented ones."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, word62 = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(words) if rng.random() < 0.6 else pick("aeioulnrstdm", rng.randint(2, 9))
    prose = lambda k: " ".join(word() for _ in range(k))
    joined = lambda: rng.choice(["-", "_", ""]).join(rng.choice(words) for _ in range(rng.randint(3, 5)))
    long_word = lambda: rng.choice([joined, lambda: pick("aeioulnrst", rng.randint(12, 24))])() + pick(string.digits, rng.randint(1, 4))
    key = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret"])
    name = lambda: rng.choice(["commit", "sha256", "md5", "checksum", "hash", "uuid", "etag", "order", "id", "version"])
    value = lambda: rng.choice([pick(hexes, rng.randint(16, 64)), pick(word62, rng.randint(16, 48)), pick(word62 + "+/", rng.randint(24, 64))])
    letters = string.ascii_letters
    mixed = lambda k: rng.choice(string.ascii_uppercase) + pick(word62, k) + rng.choice("@!#$%^*") + rng.choice(string.digits) + pick(word62, k)
    given = lambda v: rng.choice([f"{key()}={v}", f'{key()}="{v}"', f'{key()} = "{v}"', f"{key()}: {v}", f"{key()} is {v}"])
    plain = lambda: rng.choice([rng.choice(words), pick("aeioulnrst", rng.randint(6, 14))]).ljust(SHORT, "e")
    phrase = lambda: (rng.choice(words) + rng.choice(words) + rng.choice(words))[: rng.randint(11, 18)].ljust(10, "o")  # noqa: E731  words run together
    secrets = [
        lambda: f"{key()}={value()}",
        lambda: f"{key()} = \"{value()}\"",
        lambda: f"{key()}: {value()}",
        lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16),
        lambda: rng.choice(["ghp_", "gho_", "ghs_", "glpat-", "sk_live_", "rk_live_", "npm_"]) + pick(word62, rng.randint(16, 40)),
        lambda: f"xox{rng.choice('baprs')}-" + "-".join([*(pick(string.digits, rng.randint(10, 13)) for _ in range(rng.randint(1, 3))), pick(rng.choice([word62, string.ascii_lowercase]), rng.randint(16, 32))]),
        lambda: f"SG.{pick(word62 + '_-', 22)}.{pick(word62 + '_-', 43)}",
        lambda: ".".join(["eyJ" + pick(word62, rng.randint(16, 40)), "eyJ" + pick(word62, rng.randint(20, 90)), pick(word62 + "_-", 43)]),
        lambda: f"{rng.choice(['key', key()])} {rng.choice(['is', 'was', '-', ''])} {pick(letters, rng.randint(18, 34))}",
        lambda: f"{key()} {rng.choice(['is ', 'was ', '', ''])}{rng.choice([plain(), rng.choice(words)])}{pick(string.digits, rng.randint(1, 4))}",
        lambda: f"{rng.choice(['my', 'the', 'our'])} {key()} {rng.choice(['is', 'was'])} {phrase()}",
        lambda: "Authorization: Bearer " + "eyJ" + pick(word62, rng.randint(30, 60)),
        lambda: "AIza" + pick(word62 + "_-", 35),
        lambda: f'{{"{name()}":"{rng.randint(1, 999)}","{key()}":"{value()}"}}',
        lambda: f"https://{pick('abcdefgh', 8)}.com/list?{name()}={rng.randint(1, 999)}&{key()}={value()}",
        lambda: "AKIA" + pick(string.ascii_uppercase, 16),
        lambda: f"{rng.choice([key() + '=', key() + ': '])}{pick(rng.choice([letters, string.ascii_lowercase]), rng.randint(16, 32))}",
        lambda: given(pick(letters, rng.randint(2, 5)) + pick(string.digits, rng.randint(1, 3)) + pick(word62, rng.randint(3, 7))),
        lambda: given(mixed(rng.randint(3, 7))),
    ]
    others = [
        lambda: f"{name()} {pick(hexes, rng.randint(16, 64))}",
        lambda: pick(hexes, rng.randint(24, 64)),
        lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: pick(string.digits, rng.choice([16, 16, 18, 20])),
        lambda: f"/{long_word()}/{long_word()}/page{rng.randint(1, 99)}.html",
        lambda: f"https://www.{pick('abcdefgh', 8)}.com/{long_word()}/index{rng.randint(1, 9)}",
        lambda: f"{long_word()}@mail{rng.randint(1, 9)}.example.com",
        long_word,
        lambda: f"{key()}=your_{rng.choice(['password', 'token', 'secret'])}_here_{rng.randint(1, 99)}",
        lambda: f"{key()}=example-placeholder-{rng.randint(100, 999)}",
        lambda: f"{key()}={'x' * rng.randint(16, 30)}{rng.randint(0, 9)}",
        lambda: f"release-{rng.randint(1, 20)}.{rng.randint(1, 20)}-build-{rng.randint(1000, 99999)}-version",
        lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}-report-number-{rng.randint(1, 999)}",
        lambda: f'{{"{key()}":"","{name()}":"{pick(hexes, rng.randint(16, 64))}"}}',
        lambda: f"https://{pick('abcdefgh', 8)}.com/list?{name()}={pick(hexes, rng.randint(16, 64))}&page={rng.randint(1, 99)}",
        lambda: f"{key()} {plain()} {rng.choice(['is', 'was', 'of'])}",
        lambda: f"{key()} {rng.choice(['is', 'was', 'of', 'for'])} {rng.choice(words).ljust(SHORT, 'e')}",
        lambda: f"{rng.choice(['my', 'the', 'our'])} {key()} {rng.choice(['is', 'was'])} {rng.choice(words).ljust(SHORT, 'e')}",
        lambda: f"{rng.choice(['', 'src=', 'url('])}data:{rng.choice(['image/png', 'image/jpeg', 'font/woff2'])};base64,{rng.choice(['iVBORw0KGgo', '/9j/4AAQ', 'R0lGODlh', 'd09GMgAB'])}{pick(word62 + '+/', rng.randint(20, 200))}{rng.choice(['', '=', '=='])}",
        lambda: f"src=\"data:image/{rng.choice(['png', 'gif', 'svg+xml'])};base64,{pick(word62, rng.randint(40, 400))}\"",
        lambda: f"url(data:image/png;base64,iVBORw0KGgo{'A' * rng.randint(1, 6)}{pick(word62, rng.randint(20, 80))})",
        lambda: f"{rng.choice(['postgres', 'mysql', 'redis', 'amqp', 'mongodb'])}://{rng.choice(['localhost', 'db.' + pick('abcdefgh', 6) + '.com'])}:{rng.choice([5432, 3306, 6379, 5672, 27017])}/{rng.choice(['app', rng.choice(words), 'main'])}",
        lambda: "".join(w.capitalize() for w in [rng.choice([rng.choice(words), pick("aeioulnrstdmpcbg", rng.randint(4, 9))]) for _ in range(rng.randint(4, 6))]),
        lambda: rng.choice(["", "the class ", "see "]) + "".join(pick("aeioulnrstdmpcbg", rng.randint(4, 9)).capitalize() for _ in range(rng.randint(4, 6))),
        lambda: f"{plain()}: {plain()}",
        lambda: f'{pick("abcdefgh", 5)}="{plain()}{rng.choice(["", "-", "_"])}{plain()}"',
        lambda: f"{key()}={rng.choice(['changeme', 'example', 'placeholder', 'your_password', 'your-token-here', 'xxxxxxxx'])}",
    ]
    out = []
    for i in range(n):
        y = i % 2
        out.append((i, f"{prose(rng.randint(0, 5))} {rng.choice(secrets if y else others)()} {prose(rng.randint(0, 4))}".strip(), y))
    return out


class Tree:
    """A classification tree in arrays: feature (-1: leaf), cut, left, right, share of ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self.grow(x, y, rng, depth)

    def grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        me = len(self.feature)
        for col, v in ((self.feature, -1), (self.cut, 0.0), (self.left, me), (self.right, me), (self.value, float((y.sum() + 0.5) / (len(y) + 1)))):
            col.append(v)
        if depth == 0 or len(y) < 6 or y.min() == y.max():
            return me
        best = (1e-9, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                n1 = at + 1.0
                p1, p2 = ones[at] / n1, (ones[-1] - ones[at]) / (len(y) - n1)
                gain = whole - (n1 * p1 * (1 - p1) + (len(y) - n1) * p2 * (1 - p2)) / len(y)
                if gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            self.feature[me], self.cut[me] = best[1], best[2]
            self.left[me] = self.grow(x[go], y[go], rng, depth - 1)
            self.right[me] = self.grow(x[~go], y[~go], rng, depth - 1)
        return me


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[Tree]:
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(Tree(x[rows], y[rows], rng, depth))
    return out


def forest_score(trees: list[Tree], features: str) -> Column:
    """The trees' mean share of ones: all trees lie in one row of arrays, a node names its children by their places there.

    The features are bound once, as a lambda's variable: inside the walk the optimizer would compute them anew at each node."""
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    for t in trees:
        base = len(feature)
        roots.append(base)
        feature += [max(f, 0) for f in t.feature]
        cut += t.cut
        left += [base + k for k in t.left]
        right += [base + k for k in t.right]
        value += t.value
    feature, cut, left, right, value = (F.lit(v) for v in (feature, cut, left, right, value))

    def walked(x: Column) -> Column:
        step = lambda node, _: F.when(F.get(x, F.get(feature, node)) <= F.get(cut, node), F.get(left, node)).otherwise(F.get(right, node))  # noqa: E731  leaves lead to themselves
        leaves = F.transform(F.lit(roots), lambda r: F.get(value, F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), r, step)))
        return F.aggregate(leaves, F.lit(0.0), lambda s, v: s + v) / len(trees)

    return F.get(F.transform(F.array(F.col(features)), walked), F.lit(0))


class Scanner:
    """A forest and the dictionary that its features were computed with."""

    def __init__(self, trees: list[Tree], known: Dictionary):
        self.trees, self.known = trees, known


def train(spark: SparkSession, findings: list[tuple[int, str, int]] | None = None, known: Dictionary | None = None) -> Scanner:
    """A scanner from labelled findings (number, text, 1 for a secret); every candidate of a text has its label."""
    known = known or Dictionary([])
    findings = made_findings(known.words) if findings is None else findings
    rows = candidates(spark.createDataFrame(findings, "doc_id long, text string, y int").select("doc_id", "text"), known).select("doc_id", "word", "features").collect()
    label = {i: y for i, _, y in findings}
    rows = sorted((r["doc_id"], r["word"], r["features"]) for r in rows)
    return Scanner(forest(np.array([r[2] for r in rows], float), np.array([label[r[0]] for r in rows], float)), known)


def scan_secrets(docs: DataFrame, scanner: Scanner, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, word, length, sha256 of the candidate, score, secret: one row for each candidate, false positives with secret false."""
    rows = candidates(docs, scanner.known).withColumn("score", forest_score(scanner.trees, "features"))
    return rows.select("doc_id", "word", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"), "score", (F.col("score") >= threshold).alias("secret"))


def finding_hash(candidate: str) -> str:
    return hashlib.sha256(candidate.encode()).hexdigest()
