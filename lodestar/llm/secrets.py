"""Secret scans: patterns propose, a random forest removes false positives.

Candidates are long unbroken tokens, dotted tokens, private-key blocks, and
values of any length that are assigned to a name of a secret. The forest sees a
candidate's length and character transitions, how much of it a dictionary
covers, the words before and after it, and the document's path. The dictionary
holds pieces of words and the words that are frequent in the whole corpus.
The forest is trained, with the same dictionary, from labelled findings: those given by the caller, or a seeded set of findings made from formats that are
public, both secrets and things that look like them.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_sample, discard, stash, table

# What may be a secret.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"
# Tokens of three dotted parts, and blocks that hold a private key.
DOTTED = r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])"
BLOCK = r"-----BEGIN (?P<kind>[A-Z ]*PRIVATE KEY)-----[^-]++-----END (?P=kind)-----"
# Words before a secret, and words before what is none.
NAMES = ["token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "auth", "bearer", "credential", "access"]
# A name that ends as those do, and its value: quoted, a parameter of a URL, or up to white space but for marks that end a clause.
ASSIGNED = r"""(?i)(?P<name>token|secret|key|password|passwd|pwd|auth|bearer|credential|access)s?["']?[ \t]*+(?::=|=>|==?|:)[ \t]*+(?:"(?P<double>[^"\n]++)"|'(?P<single>[^'\n]++)'|(?P<bare>[^\s"']++))"""
# The same within an unquoted value, where a value ends at the next mark; so the work stays linear.
NESTED = r"""(?i)(?:token|secret|key|password|passwd|pwd|auth|bearer|credential|access)s?(?::=|=>|==?|:)([^\s"'&#,;:=]++)"""
# Characters of a parameter's name in a URL.
PARAMETER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.%-"
OTHERS = ["sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "id", "etag", "revision", "version"]
# Beginnings that issuers give their tokens.
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "AIza", "glpat-", "eyJ"]
# Path endings under which secrets are usual.
PATHS = [".env", ".pem", ".key", ".cfg", ".ini", ".yml", ".yaml", ".properties", ".tf"]
# The dictionary, pieces of which ordinary words are made.
PIECES = ["tion", "ment", "ing", "the", "and", "con", "pro", "ver", "ent", "ate", "ble", "ness", "able", "that", "with", "this", "from", "com", "org", "www", "http", "index", "html", "page", "image", "user", "data", "file", "name", "test", "over", "under", "inter", "sch", "ung", "ein", "lich", "heit", "ción", "mente", "eau", "oir", "que", "elle"]

CONTEXT = 32
TREES, DEPTH, SEED = 24, 6, 9
FINDINGS = 4_000
#: Words join the dictionary that make at least a RARITY-th of the corpus's words, of so many letters.
RARITY, LEAST_LETTERS, MOST_LETTERS = 50_000, 4, 16
THRESHOLD = 0.5
FEATURES = ["length", "entropy", "digits", "uppers", "transitions", "vowels", "coverage", "hex", "prefix", "named", "assigned", "quoted", "other", "path", "runs", "marks", "template", "classes", "other_after", "quoted_after", "dotted", "block"]


def candidate_pattern():
    return re.compile(CANDIDATE)


def proposed(text: str, tokens=re.compile(CANDIDATE), assigned=re.compile(ASSIGNED), nested=re.compile(NESTED), dotted=re.compile(DOTTED), block=re.compile(BLOCK)) -> list[tuple[int, int]]:
    """Sorted (start, stop) of all candidates: they may overlap, equal ones are listed once."""
    found = {m.span() for pattern in (tokens, dotted, block) for m in pattern.finditer(text)}
    at = 0
    while m := assigned.search(text, at):
        start, stop = m.span(m.lastgroup)
        at = start  # a value may hold a name and value of its own
        if m.lastgroup == "bare":
            inner, at = start, stop
            while n := nested.search(text, inner, stop):
                inner = n.start(1)
                found.add((inner, inner + _clause(n[1])))
            value = re.split("[&#]", m["bare"], maxsplit=1)[0] if _parameter(text, m.start("name")) else m["bare"]
            stop = start + _clause(value)
        found.add((start, stop))
    return sorted(s for s in found if s[1] > s[0])


def _parameter(text: str, at: int) -> bool:
    """Whether the name that goes on at `at` is a parameter of a URL. A name holds no mark that ends one, so looking back stays linear."""
    while at and text[at - 1] in PARAMETER:
        at -= 1
    return at > 0 and text[at - 1] in "?&"


def _clause(value: str) -> int:
    """The length of value without marks at its end that end a clause, or a bracket that it doesn't open."""
    n = len(value.rstrip(",;.)]}>"))
    opened = sum(value[:n].count(c) for c in "([{<")
    rest = value[n:]
    while opened and rest and rest[0] in ")]}>":
        opened, n, rest = opened - 1, n + 1, rest[1:]
    return n


def _parts(words: list[str]) -> set[str]:
    """The words without a plural s, and their parts between underscores."""
    return {p.removesuffix("s") if len(p) > 3 else p for w in words for p in (w, *w.split("_"))}


def dictionary(docs: DataFrame, rarity: int = RARITY) -> frozenset[str]:
    """Words of LEAST_LETTERS letters to MOST_LETTERS that occur twice and make a `rarity`th of all such words: so at most `rarity`, whatever the corpus."""
    found = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}]+")).alias("word"))
    counted = stash(found.where(F.char_length("word").between(LEAST_LETTERS, MOST_LETTERS)).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    total = counted.agg(F.sum("n")).head()[0] or 0
    words = frozenset(r["word"] for r in counted.where((F.col("n") > 1) & (F.col("n") * rarity >= F.lit(total))).select("word").collect())
    discard(counted)
    return words


def coverage(low: str, words: frozenset[str]) -> float:
    """The share of characters that pieces and words cover."""
    n = len(low)
    covered = bytearray(n)
    for piece in PIECES:
        at = low.find(piece)
        while at >= 0:
            covered[at : at + len(piece)] = b"\x01" * len(piece)
            at = low.find(piece, at + 1)
    if words:
        for run in re.finditer(r"[^\W\d_]{4,}", low):
            letters, first = run[0], run.start()
            for at in range(len(letters) - LEAST_LETTERS + 1):
                for size in range(min(MOST_LETTERS, len(letters) - at), LEAST_LETTERS - 1, -1):
                    if letters[at : at + size] in words:
                        covered[first + at : first + at + size] = b"\x01" * size
                        break
    return sum(covered) / n


def features(span: str, before: str, path: str, after: str = "", words: frozenset[str] = frozenset()) -> list[float]:
    """FEATURES of a candidate; before is the text that ends where it starts, after that which starts where it ends."""
    n = len(span)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in span]
    counts: dict[str, int] = {}
    for c in span:
        counts[c] = counts.get(c, 0) + 1
    low = span.lower()
    parts = _parts(re.findall(r"[a-z_0-9]+", before.lower())[-3:])
    following = _parts(re.findall(r"[a-z_0-9]+", after.lower())[:2])
    return [
        float(n),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        kinds.count("d") / n,
        kinds.count("u") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(c in "aeiou" for c in low) / n,
        coverage(low, words),
        float(all(c in "0123456789abcdef" for c in low)),
        float(any(span.startswith(p) for p in PREFIXES)),
        float(any(p.endswith(tuple(NAMES)) for p in parts)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"')),
        float(not parts.isdisjoint(OTHERS)),
        float(any(path.lower().endswith(p) for p in PATHS)),
        max((len(m[0]) for m in re.finditer(r"(.)\1*", span, re.S)), default=0) / n,
        sum(k == "s" and c not in "+/_-=" for k, c in zip(kinds, span)) / n,
        float(bool(re.search(r"[$<{(\[*%]", span[:1])) or "(" in span or " " in span),
        float(len(set(kinds) - {"s"})),
        float(not following.isdisjoint(OTHERS)),
        float(after[:1] in ("'", '"')),
        float(span.startswith("eyJ") and span.count(".") == 2),
        float(span.startswith("-----BEGIN ")),
    ]


# How a name leads to its value, and values that stand for a secret and are none.
_LEADS = ['{} = "', "{} = '", '{}="', "{}='", "{}=", "{}: ", '"{}": "', "{} := ", "?{}=", "&{}="]
_EMPTY = ["None", "null", "nil", "true", "false", "undefined", "required", "optional", "changeme", "Null", "True"]
_PLACEHOLDERS = ["${{{}}}", "$({})", "<{}>", "{{{{ {} }}}}", "%{}%", "your_{}", "os.{}", "{}[0]", "self.{},", "get_{}()"]


def _cased(rng, name: str) -> str:
    """A name as it stands in code and settings."""
    return rng.choice([name, name, name.upper(), f"DB_{name.upper()}", f"client_{name}", f"AWS_SECRET_{name.upper()}", f"db{name.capitalize()}"])


def _password(rng, pick, alphabet: str) -> str:
    """Four characters to fifteen, of at least two of letters, digits and other marks."""
    marks = "!@#$%^&*?.,:;~+-_"
    size = rng.randint(4, 15)
    word = rng.choice(PIECES[:38]).translate(str.maketrans("aeio", "4310")) if rng.random() < 0.4 else rng.choice(PIECES[:38])
    body = rng.choice([pick(alphabet, size), pick(alphabet + marks, size), word.capitalize() + pick("0123456789", rng.randint(1, 4)) + pick(marks, rng.randint(0, 2)), word + pick("0123456789", rng.randint(1, 4)), word + pick(marks, 1) + pick(alphabet, rng.randint(2, 6))])
    return body if sum(map(bool, (re.search("[A-Za-z]", body), re.search("[0-9]", body), re.search("[^A-Za-z0-9]", body)))) > 1 else body[:13] + pick("0123456789", 2)


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int, str]]:
    """Seeded findings (span, before, path, label, after): about half are secrets, half look like them."""
    return _tokens_and_values(count, seed) + _blocks_and_dotted(count // 8, seed + 1)


def _blocks_and_dotted(count: int, seed: int) -> list[tuple[str, str, str, int, str]]:
    """Private keys and dotted tokens, and unbroken tokens that the words after them name as something else."""
    rng = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    out = []
    for _ in range(count):
        lead = " ".join(rng.choice(PIECES[:20]) for _ in range(3)) + rng.choice([" ", "\n", ": "])
        kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY"
        body = "\n".join(pick(alphabet + "+/", 64) for _ in range(rng.randint(2, 30)))
        out.append((f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----", lead, "", 1, "\n"))
        out.append((f"eyJ{pick(alphabet, rng.randint(20, 60))}.eyJ{pick(alphabet, rng.randint(20, 200))}.{pick(alphabet + '-_', 43)}", lead, "", 1, rng.choice(["", '"', "\n"])))
        name = rng.choice(OTHERS)
        out.append((pick("0123456789abcdef", rng.choice([32, 40, 64])), lead, "", 0, f" ({name})" if rng.random() < 0.5 else f" {name}"))
    return out


def _after(rng, lead: str) -> str:
    """What follows a value after such a lead: its closing quote, or what ends a word."""
    return lead[-1:] if lead[-1:] in ("'", '"') else rng.choice(["", "\n", " then", " the", "&page=1" if lead[:1] in ("?", "&") else ";"])


def _tokens_and_values(count: int, seed: int) -> list[tuple[str, str, str, int, str]]:
    rng = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: "".join(rng.choice(PIECES[:20] + ["er", "in", "on", "re", "an", "es", "or"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(count):
        before = " ".join(word() for _ in range(4)) + " "
        path = rng.choice(["", "src/main.c", "a/readme.md", "conf/app.env", "conf/site.yml", "page.html"])
        if i % 8 == 7:
            out.append((_password(rng, pick, alphabet), before + rng.choice(_LEADS).format(_cased(rng, rng.choice(NAMES))), path, 1))
        elif i % 8 == 6:
            body = rng.choice([word, lambda: rng.choice(_EMPTY), lambda: rng.choice(_EMPTY), lambda: word().capitalize(), lambda: word().upper(), lambda: rng.choice(_PLACEHOLDERS).format(word()), lambda: str(rng.randrange(10 ** rng.randint(1, 6))), lambda: f"{word()} {word()}", lambda: f"{word()}.{word()}", lambda: f"{word()}-{word()}", lambda: f"{word()}()", lambda: rng.choice("*x.-?") * rng.randint(3, 15)])()
            out.append((body, before + rng.choice(_LEADS).format(_cased(rng, rng.choice(NAMES))), path, 0))
        elif i % 40 == 8:
            out.append((pick(alphabet + "+/", rng.randint(400, 4000)), before + rng.choice(["data:image/png;base64,", "data:font/woff2;base64,", "src=", ""]), path, 0))
        elif i % 2:
            body = rng.choice([lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: pick(alphabet, rng.randint(20, 48)), lambda: rng.choice(PREFIXES) + pick(alphabet, rng.randint(16, 36)), lambda: pick(alphabet + "+/", 40), lambda: pick(alphabet + "+/", rng.randint(200, 4000)), lambda: "eyJ" + pick(alphabet + "-_", rng.randint(200, 2000))])()
            name = _cased(rng, rng.choice(NAMES))
            lead = rng.choice([f'{name} = "', f"{name}: ", f"{name}='", f'"{name}": "', f"{name}=", f"{name.upper()}=", f"?{name}=", f"&{name}="])
            if any(body.startswith(p) for p in PREFIXES) and rng.random() < 0.4:
                lead = ""
            out.append((body, before + lead, path, 1))
        else:
            kind = rng.randrange(7)
            if kind == 0:
                body, lead = pick("0123456789abcdef", rng.choice([32, 40, 64])), rng.choice(OTHERS) + rng.choice([" ", ": ", "="])
            elif kind == 1:
                body, lead = "".join(word() for _ in range(6))[: rng.randint(16, 60)].ljust(16, "e"), rng.choice(["", "key ", "token "])
            elif kind == 2:
                body, lead = "/".join(word() for _ in range(5)).ljust(16, "a"), rng.choice(["", "http:", "see "])
            elif kind == 3:
                body, lead = pick("0123456789", rng.randint(16, 20)), ""
            elif kind == 4:
                body, lead = rng.choice("-_=ae0") * rng.choice([rng.randint(16, 40), rng.randint(16, 900)]), ""
            elif kind == 5:
                h = "0123456789abcdef"
                body, lead = f"{pick(h, 8)}-{pick(h, 4)}-{pick(h, 4)}-{pick(h, 4)}-{pick(h, 12)}", rng.choice(["uuid=", "id: ", ""])
            else:
                body, lead = "_".join(word() for _ in range(4)).upper().ljust(16, "E"), rng.choice(["", "name=", 'key = "'])
            out.append((body, before + lead, path, 0))
    return [(*finding, _after(rng, finding[1])) for finding in out]


def _grow(x, y, rng, depth: int):
    """A tree as nested tuples (feature, cut, low, high), or a share of positives."""
    import numpy as np

    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 8:
        return share
    best = None
    for f in rng.choice(x.shape[1], 4, replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        for cut in np.unique(np.quantile(values, np.linspace(0.1, 0.9, 9))):
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            if not len(a) or not len(b):
                continue
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0]:
                best = (impurity, int(f), float(cut), low)
    if best is None:
        return share
    _, f, cut, low = best
    return f, cut, _grow(x[low], y[low], rng, depth - 1), _grow(x[~low], y[~low], rng, depth - 1)


def findings_of(table: DataFrame, most: int = FINDINGS) -> list[tuple[str, str, str, int, str]]:
    """Labelled findings from a table with span, before, path, label (0 or 1) and after: `most` distinct rows at most, those with the least hashes.

    Rows without a span or with another label are left out; NULL contexts and paths are empty. Other columns are ignored.
    """
    known = table.where("span is not null and span != '' and label in (0, 1)")
    rows = bounded_sample(known.select("span", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "path")], F.col("label").cast("int").alias("label"), F.coalesce(F.col("after"), F.lit("")).alias("after")), most, SEED)
    return sorted(map(tuple, rows.collect()))


def fit_forest(findings, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, words: frozenset[str] = frozenset()) -> list:
    """Trees on bootstrap samples of labelled findings (span, before, path, label, and after where known), with the dictionary that they will score with."""
    import numpy as np

    x = np.array([features(f[0], f[1], f[2], f[4] if len(f) > 4 else "", words) for f in findings])
    y = np.array([f[3] for f in findings], "f8")
    rng = np.random.default_rng(seed)
    return [_grow(x[own], y[own], rng, depth) for own in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def probability(forest: list, row: list[float]) -> float:
    total = 0.0
    for tree in forest:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        total += tree
    return total / len(forest)


def scan(docs: DataFrame, findings: list | None = None, threshold: float = THRESHOLD, path_column: str | None = None) -> DataFrame:
    """One row per candidate that the forest keeps: doc_id, start, stop (code points), score, secret_sha256; the secret itself isn't copied.

    NULL and empty texts have no rows; NULL ids and paths pass, a NULL path is
    empty. Rows are independent: repeated rows give repeated findings. Other
    columns are ignored. Texts are searched whole and tokens have no greatest
    length. Findings may overlap where a token is part of an assigned value.
    """
    words = dictionary(docs)
    forest = fit_forest(findings if findings is not None else labelled_findings(), words=words)
    shared = docs.sparkSession.sparkContext.broadcast((forest, words))

    def run(batches):
        import hashlib

        import pyarrow as pa

        model, words = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("secret_sha256", pa.string())])
        for batch in batches:
            out: dict = {n: [] for n in schema.names}
            for doc_id, text, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, stop in proposed(text or ""):
                    span = text[start:stop]
                    score = probability(model, features(span, text[max(0, start - CONTEXT) : start], path or "", text[stop : stop + CONTEXT], words))
                    if score >= threshold:
                        for name, value in zip(out, (doc_id, start, stop, score, hashlib.sha256(span.encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path")).mapInArrow(run, "doc_id long, start long, stop long, score double, secret_sha256 string")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents; the source column stands for the path."""
    return scan(table(spark, sf_dir, "documents"), path_column="source")
