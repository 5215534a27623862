"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The patterns' spans always stand. The field tags the tokens between white space
as secret begin (B), inside (I) or outside (O), from the token's own shape,
its neighbours (their shapes and words), open quotation marks and features of the
file, and is decoded by Viterbi; what it tags where no pattern matches is added as
kind ``crf``. It learns from whole texts of a bounded sample: from the patterns'
spans, from the same spelt anew in other alphabets, and from secrets of several
tokens (key blocks, quoted pass phrases, keys in groups) and look-alikes
that are planted there. It sees shapes and words, not patterns, so it finds
secrets under other names and of other forms.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.llm.common import kept_in_worker, sampled, sent_to_workers, table, texts, with_columns

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
#: Any assignment holds one of these, in lower case.
HINTS = ("pass", "secret", "token", "api")

#: A neighbour that names a secret may also hold one of these.
NAMES = (*HINTS, "key", "auth", "cred", "pwd", "phrase", "bearer")
NEAR = {(a, b, c, d): (f"near={a}{b}", f"far={c}{d}") for a in (False, True) for b in (False, True) for c in range(6) for d in (False, True)}

#: Bounds on the texts that a fit learns from, with a match of the patterns and without: so
#: many of each, chosen by a hash of the id, as long as they have no more characters together.
SAMPLE, SAMPLED_CHARS = 300, 2_000_000
#: A text's chain is cut into chains of so many tokens to learn from; features reach over the cuts.
CHAIN = 64
#: Passages planted in each text.
PLANTED = 3
ROUNDS = 100
RIDGE = 0.1
STEP = 0.1
O, B, I = 0, 1, 2  # noqa: E741
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
WORD = re.compile(r"\S+")
ALPHABETS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/_-", string.ascii_lowercase + string.digits]
PLAIN = [("plain", f"length={k}") for k in range(13)]
#: A quotation that isn't closed within so many tokens is none.
QUOTED = 12
#: A token's class is kept for so many tokens.
CACHE = 200_000
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans in code points, leftmost and non-overlapping per kind,
    by start, then kind as listed. Both runs are greedy over one class, so a
    least length in the pattern finds what dropping short matches would; an
    assignment's match takes its text even if it is dropped."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for k, a, b in sorted(found, key=lambda x: (x[1], x[0]))]


def shape(token: str) -> tuple[str, ...]:
    """Names of the token's own features; its class. A plain word, capitalised or
    not, has no more than its length."""
    word = token.rstrip(".,;:!?")
    if word.isalpha() and (word.islower() or word[1:].islower()):
        return PLAIN[min(len(word), 48) // 4]
    run = max(RUN.findall(token), key=len, default="")
    n = len(run)
    digits, upper, lower = (sum(map(f, run)) for f in (str.isdigit, str.isupper, str.islower))
    turns = sum((a.isdigit() != b.isdigit()) or (a.isalpha() and b.isalpha() and a.isupper() != b.isupper()) for a, b in zip(run, run[1:], strict=False))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(run).values()) if n else 0.0
    kinds = ("d" if digits else "") + ("u" if upper else "") + ("l" if lower else "") + ("s" if digits + upper + lower < n else "")
    return (
        f"kinds={kinds}",
        f"length={min(n, 48) // 4}",
        f"digits={int(4 * digits / n) if n else 0}{'' if n < 16 else '+'}",
        f"turns={int(10 * turns / n) if n else 0}{'' if n < 16 else '+'}",
        f"entropy={int(2 * entropy)}",
        f"hex={n >= 16 and all(c in '0123456789abcdef' for c in run)}",
        f"outside={min(len(token) - n, 4)}",
        f"joint={'=' in token[:-1]}{':' in token[:-1]}{'@' in token}{'//' in token}",
        f"ends={'.' in token.strip('.,;')}{token[-1] if not token[-1].isalnum() else 'a'}",
    )


def near(token: str) -> tuple[str, ...]:
    """What a neighbour sees of a token: whether it names or joins something, a coarse shape, and its word."""
    low = token.lower()
    named = any(h in low for h in NAMES)
    joins = low.rstrip("\"'`").endswith((":", "="))
    coarse = NEAR[named, joins, min(len(token), 40) // 8, not token.isalpha() and any(map(str.isdigit, token))]
    word = low.strip(".,;:=!?\"'`()-")
    return (*coarse, f"word={word}") if word.isalpha() and len(word) <= 20 else coarse


def told(token: str, words: set[str]) -> tuple[str, ...]:
    """What a neighbour sees of a token, its word only if it is one of those."""
    return tuple(n for n in near(token) if not n.startswith("word=") or n in words)


def quotes(tokens: list[str]) -> dict[int, str]:
    """Feature of the tokens that open, close or are in a quotation of several
    tokens, and whether what stands before it names a secret."""
    out: dict[int, str] = {}
    opened = -1
    for k in [k for k, w in enumerate(tokens) if '"' in w or "`" in w]:
        if (tokens[k].count('"') + tokens[k].count("`")) % 2 == 0:
            continue
        if opened >= 0 and k - opened < QUOTED:
            lead = " ".join([*tokens[max(0, opened - 2) : opened], re.split("[\"`]", tokens[opened])[0]]).lower()
            named = any(h in lead for h in NAMES)
            out[opened] = f"open={named}"
            for m in range(opened + 1, k):
                out[m] = f"in={named}"
            out[k] = f"close={named}"
            opened = -1
        else:
            opened = k
    return out


def file_features(text: str, n: int) -> tuple[str, ...]:
    """Of the whole text: its length, and how much it looks like code."""
    marks = text.count("=") + text.count("{") + text.count(";")
    return (f"tokens={int(math.log2(n + 1)) // 2}", f"marks={min(4, int(20 * marks / (n + 1)))}")


def labelled(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens, and the tags that the patterns' spans give them."""
    spots = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    tags = np.zeros(len(spots), np.int64)
    starts = np.array([s[1] for s in spots])
    for _, _, b in base_spans(text):
        # The value of an assignment ends the span; its name isn't secret.
        tags[int(np.searchsorted(starts, b, "left")) - 1] = B
    return [s[0] for s in spots], tags


def disguised(tokens: list[str], tags: np.ndarray, digest: bytes) -> list[str]:
    """The tokens, those tagged with their longest run spelt anew in one of
    three alphabets: secrets of forms that the patterns don't know."""
    out = list(tokens)
    for k in np.flatnonzero(tags):
        run = max(RUN.finditer(tokens[k]), key=lambda m: m.end() - m.start(), default=None)
        if run and run.end() - run.start() >= 16:
            letters = ALPHABETS[digest[k % 16] % 3]
            h = hashlib.shake_128(digest + tokens[k].encode()).digest(run.end() - run.start())
            out[k] = tokens[k][: run.start()] + "".join(letters[c % len(letters)] for c in h) + tokens[k][run.end() :]
    return out


# What stands before planted secrets, and before planted look-alikes.
PHRASE_LEADS = ("passphrase:", "password is", "secret phrase =", "pwd:", "recovery phrase:", "login password")
GROUP_LEADS = ("license key:", "api key", "auth key =", "secret key is", "activation key:", "credential:")
BLOCK_NAMES = ("RSA PRIVATE", "PRIVATE", "EC PRIVATE", "OPENSSH PRIVATE", "PGP PRIVATE")
QUOTE_LEADS = ("he said", "the title", "called", "as in", "a sign read", "she wrote:")
DIGIT_LEADS = ("call", "phone:", "order number", "dial", "invoice", "account of")


def spelt(digest: bytes, salt: str, letters: str, n: int) -> str:
    return "".join(letters[c % len(letters)] for c in hashlib.shake_128(digest + salt.encode()).digest(n))


def planted(tokens: list[str], digest: bytes) -> tuple[list[str], np.ndarray]:
    """The tokens with a passage put in at a place that the digest says: a key block, a quoted
    pass phrase, a key in groups, or else a plain quotation, a number in groups or words in capitals; and its tags."""
    kind, at = digest[0] % 6, int.from_bytes(digest[1:4], "big") % (len(tokens) + 1)
    pick = lambda values, k: values[digest[k] % len(values)]
    plain = sorted({t for t in tokens if t.isalpha() and t.islower()}) or ["word"]
    words = [plain[b % len(plain)] for b in digest[4 : 7 + digest[7] % 3]]
    base64 = ALPHABETS[0] + "+/"
    if kind == 0:
        name = pick(BLOCK_NAMES, 8)
        before, after = f"-----BEGIN {name} KEY-----".split(), f"-----END {name} KEY-----".split()
        lines = 2 + digest[9] % 7
        secret = [spelt(digest, f"line {k}", base64, 64 if k + 1 < lines else 20 + digest[10] % 44) for k in range(lines)]
        tags = [B] + [I] * (lines - 1)
    elif kind in (1, 3):
        lead = pick(PHRASE_LEADS if kind == 1 else QUOTE_LEADS, 8)
        before, after = lead.split(), []
        secret = ['"' + words[0], *words[1:-1], words[-1] + '"' + ("", ".", ",")[digest[9] % 3]]
        if kind == 1 and digest[10] % 2 and lead[-1] in ":=":
            before, secret[0] = before[:-1], before[-1].rstrip(":") + "=" * (not lead.endswith("=")) + secret[0]
        tags = [B] + [I] * (len(secret) - 1) if kind == 1 else [O] * len(secret)
    elif kind == 5:
        before, secret, after = [], [w.upper() + ("", "!!", ",")[digest[9] % 3] for w in words], []
        tags = [O] * len(secret)
    else:
        letters = (string.ascii_uppercase + string.digits, ALPHABETS[0], ALPHABETS[2])[digest[9] % 3] if kind == 2 else string.digits
        before, after = pick(GROUP_LEADS if kind == 2 else DIGIT_LEADS, 8).split(), []
        groups, size = 3 + digest[10] % 3, 4 + digest[11] % 3
        secret = [spelt(digest, f"group {k}", letters, size) for k in range(groups)]
        tags = [B] + [I] * (groups - 1) if kind == 2 else [O] * groups
    return [*tokens[:at], *before, *secret, *after, *tokens[at:]], np.array([O] * (at + len(before)) + tags + [O] * (len(after) + len(tokens) - at))


#: Where a feature is seen: at the token itself, one before, two before, one behind, in the quotation, of the file.
OWN, BEFORE, TWICE, BEHIND, QUOTE, FILE = "o:", "p:", "r:", "n:", "q:", "f:"


@dataclass
class Field:
    """Weights by place and feature name, and transitions [from, to]."""

    weights: dict[str, np.ndarray]
    transitions: np.ndarray

    def score(self, names: tuple[str, ...], place: str) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.weights.get(place + n, zero) for n in names), zero)


def posteriors(e: np.ndarray, t: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of log partition sums, tag posteriors, expected transition counts) of chains of
    tag scores e [chain, token, tag]; ``there`` is true at tokens and false behind a chain's end."""
    n, longest, _ = e.shape
    top = e.max(axis=2)
    x, step = np.exp(e - top[..., None]), np.exp(t)
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((n, longest))
    scale[:, 0] = x[:, 0].sum(axis=1)
    alpha[:, 0] = x[:, 0] / scale[:, :1]
    for j in range(1, longest):
        a = (alpha[:, j - 1] @ step) * x[:, j]
        scale[:, j] = np.where(there[:, j], a.sum(axis=1), 1.0)
        alpha[:, j] = np.where(there[:, j, None], a / scale[:, j, None], alpha[:, j - 1])
    pairs = np.zeros((3, 3))
    for j in range(longest - 1, 0, -1):
        ahead = x[:, j] * beta[:, j] / scale[:, j, None] * there[:, j, None]
        pairs += (alpha[:, j - 1].T @ ahead) * step
        beta[:, j - 1] = np.where(there[:, j, None], ahead @ step.T, 1.0)
    return float((np.log(scale) + top)[there].sum()), alpha * beta * there[..., None], pairs


def learn(samples: Iterable[str], rounds: int = ROUNDS, ridge: float = RIDGE) -> Field | None:
    """Maximum conditional likelihood by Adam over the chains of the texts; None
    without a single pattern match."""
    words: dict[str, int] = {"": 0}
    asked: dict[str, int] = {"": 0}
    files: dict[tuple[str, ...], int] = {}
    chains: list[tuple[np.ndarray, np.ndarray, int]] = []  # (token, quotation) of a chain and its surroundings, tags, file
    some = False

    def add(tokens: list[str], tags: np.ndarray, file: int, only_tagged: np.ndarray | None = None) -> None:
        marks = quotes(tokens)
        ids = np.zeros((2, len(tokens) + 3), np.int64)
        ids[0, 2:-1] = [words.setdefault(w, len(words)) for w in tokens]
        for k, name in marks.items():
            ids[1, k + 2] = asked.setdefault(name, len(asked))
        for at in range(0, len(tokens), CHAIN):
            if only_tagged is None or only_tagged[at : at + CHAIN].any():
                chains.append((ids[:, at : at + CHAIN + 3], tags[at : at + CHAIN], file))

    for text in samples:
        tokens, tags = labelled(text)
        if not tokens:
            continue
        some |= bool(tags.any())
        file = files.setdefault(file_features(text, len(tokens)), len(files))
        digest = hashlib.md5(text.encode()).digest()
        add(tokens, tags, file)
        if tags.any():
            add(disguised(tokens, tags, digest), tags, file, tags)
        # A passage goes into the tokens around its place; the rest is there already.
        for k in range(PLANTED):
            digest = hashlib.md5(digest + bytes([k])).digest()
            mid = int.from_bytes(digest[12:], "big") % len(tokens)
            part = slice(max(0, mid - CHAIN // 2), mid + CHAIN // 2)
            if not tags[part].any():
                add(*planted(tokens[part], digest), file)
    if not some:
        return None
    index: dict[str, int] = {}

    def rows(names: list[tuple[str, ...]], place: str) -> np.ndarray:
        width = max(map(len, names))
        return np.array([[*(index.setdefault(place + n, len(index)) for n in x), *[-1] * (width - len(x))] for x in names], np.int64).reshape(len(names), width)

    # Of neighbouring words those count that stand beside a tagged token more than once; tokens that are
    # alike in all features are one class.
    beside: Counter = Counter()
    for ids, tags, _ in chains:
        hit = np.flatnonzero(tags)
        beside.update(np.unique(np.concatenate([ids[0, hit + k] for k in (0, 1, 3)])).tolist())
    telling = {f"word={w}" for w, n in Counter(x for t, k in words.items() if beside[k] for x in [near(t)[-1][5:]] * beside[k] if near(t)[-1].startswith("word=")).items() if n > 1}
    classes: dict[tuple[tuple[str, ...], tuple[str, ...]], int] = {(("edge",), ("edge",)): 0}
    of = np.array([classes.setdefault((shape(w), told(w, telling)) if w else (("edge",), ("edge",)), len(classes)) for w in words])
    own, by = ([k[p] for k in classes] for p in (0, 1))
    places = [rows(own, OWN), rows(by, BEFORE), rows(by, TWICE), rows(by, BEHIND), rows([(n,) if n else () for n in asked], QUOTE), rows(list(files), FILE)]
    longest = max(len(t) for _, t, _ in chains)
    at = np.zeros((len(places), len(chains), longest), np.int64)
    y, there = np.zeros((len(chains), longest), np.int64), np.zeros((len(chains), longest), bool)
    for k, (ids, tags, file) in enumerate(chains):
        n = len(tags)
        for p, shift in ((0, 2), (1, 1), (2, 0), (3, 3)):
            at[p, k, :n] = of[ids[0, shift : shift + n]]
        at[4, k, :n], at[5, k], y[k, :n], there[k, :n] = ids[1, 2 : 2 + n], file, tags, True
    w, t = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t)]
    gold = np.eye(3)[y] * there[..., None]
    gold_t = np.zeros((3, 3))
    for j in range(1, longest):
        np.add.at(gold_t, (y[:, j - 1], y[:, j]), there[:, j])
    for turn in range(1, rounds + 1):
        e = sum(w[names].sum(axis=1)[ids] for names, ids in zip(places, at, strict=True))
        _, p, pt = posteriors(e, t, there)
        d = (p - gold).reshape(-1, 3)
        grad = np.zeros_like(w)
        for names, ids in zip(places, at, strict=True):
            flat = ids.ravel()
            for c in range(3):
                sums = np.bincount(flat, d[:, c], len(names))
                grad[:, c] += np.bincount(names.ravel() % len(w), np.repeat(sums, names.shape[1]), len(w))
        for v, g, (first, second) in zip((w, t), (grad, pt - gold_t), moments, strict=True):
            g = (g + ridge * v) / len(chains)
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            v -= STEP * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-9)
        w[-1] = 0
    return Field({n: w[k] for n, k in index.items() if np.abs(w[k]).max() > 1e-4}, t)


class Tagger:
    """Decodes texts. Scores of a token's class are looked up, not made anew."""

    def __init__(self, field: Field):
        self.field = field
        self.classes: dict = {}
        self.tables = np.zeros((0, 12))
        self.rows: list[np.ndarray] = []
        self.tokens: dict[str, int] = {}
        t = field.transitions
        #: What a token in a secret, and the step out of one, can gain by transitions at most.
        self.into, self.out = max(0.0, float(t[:, 1:].max() - t[O, O])), max(0.0, float(t[:, O].max() - t[O, O]))
        self.words = {n[len(p) :] for n in field.weights for p in (BEFORE, TWICE, BEHIND) if n.startswith(p + "word=")}
        self.edges = [field.score(("edge",), p) for p in (BEFORE, TWICE, BEHIND)]

    def class_of(self, token: str) -> int:
        by = told(token, self.words)
        key = shape(token), by
        k = self.classes.get(key)
        if k is None:
            k = self.classes[key] = len(self.rows)
            self.rows.append(np.concatenate([self.field.score(key[0], OWN), *[self.field.score(by, p) for p in (BEFORE, TWICE, BEHIND)]]))
        return k

    def scores(self, tokens: list[str], text: str) -> np.ndarray:
        """Scores of the three tags at each token."""
        known = self.tokens
        if len(known) > CACHE:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = self.class_of(w)
        if len(self.tables) < len(self.rows):
            self.tables = np.array(self.rows)
        at = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        s = self.tables[at]
        e = s[:, 0:3] + self.field.score(file_features(text, len(tokens)), FILE)
        e[1:] += s[:-1, 3:6]
        e[2:] += s[:-2, 6:9]
        e[:-1] += s[1:, 9:12]
        e[0] += self.edges[0]
        e[:2] += self.edges[1]
        e[-1] += self.edges[2]
        if '"' in text or "`" in text:
            for k, name in quotes(tokens).items():
                e[k] += self.field.score((name,), QUOTE)
        return e

    def tags(self, tokens: list[str], text: str) -> np.ndarray:
        """The Viterbi path. A token is surely outside if no stretch that holds it can
        score more than being all outside does; such tokens part the chain into stretches, which are
        decoded one by one with the same result."""
        e = self.scores(tokens, text)
        gain = np.maximum(e[:, B], e[:, I]) - e[:, O] + self.into
        upto = np.concatenate(([0.0], np.cumsum(gain)))
        # The best sums that end, and that begin, at each token.
        ending = upto[1:] - np.minimum.accumulate(upto[:-1])
        starting = np.maximum.accumulate(upto[:0:-1])[::-1] - upto[:-1]
        open_ = np.flatnonzero(ending + starting - gain + self.out >= -1e-6 * (1 + np.abs(upto[-1])))
        tags = np.zeros(len(tokens), np.int64)
        if len(open_):
            for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                tags[part] = self.path(e[part[0] : part[-1] + 1], part[0] > 0, part[-1] + 1 < len(tokens))
        return tags

    def path(self, e: np.ndarray, before: bool, after: bool) -> list[int]:
        t = self.field.transitions
        best, back = e[0] + (t[O] if before else 0), []
        for row in e[1:]:
            through = best[:, None] + t
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        k = int((best + (t[:, O] if after else 0)).argmax())
        out = [k]
        for b in reversed(back):
            k = int(b[k])
            out.append(k)
        return out[::-1]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of tagged runs of tokens that overlap no base span."""
        tokens = text.split()
        if not tokens:
            return []
        tags = self.tags(tokens, text)
        hits = np.flatnonzero(tags)
        if not len(hits):
            return []
        # (start, end, last token, its start): one token's longest run; of several tokens all
        # between the quotation marks and other signs around them.
        out, spots, k = [], WORD.finditer(text), -1
        for h in hits:
            while k < h:
                spot, k = next(spots), k + 1
            token = spot.group()
            if tags[h] == I and out and out[-1][2] == h - 1:
                first = out[-1][3]
                end = len(token)
                while end and not token[end - 1].isalnum() and token[end - 1] not in "+/=_-":
                    end -= 1
                start = first.start() + max(map(first.group().rstrip("\"`.,;:!?").rfind, "\"`=")) + 1 if out[-1][2] == out[-1][4] else out[-1][0]
                out[-1] = (start, spot.start() + end, h, first, out[-1][4])
                continue
            run = max(RUN.finditer(token), key=lambda m: m.end() - m.start(), default=None)
            if run:
                out.append((spot.start() + run.start(), spot.start() + run.end(), h, spot, h))
        out = [("crf", a, b) for a, b, *_ in out]
        return [x[:3] for x in out if not any(a < x[2] and x[1] < b for _, a, b in base)]


#: The patterns for Spark, to tell texts with a match from those without.
MATCHES = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLED_CHARS) -> Field | None:
    """Learns from at most ``sample`` texts with a match and as many without, of at most
    ``chars`` characters each together, those of the least hash of the id; None if no pattern
    matches there. Rows of null ids teach nothing, equal rows count one by one up to the bound."""
    rows = texts(docs).where("doc_id IS NOT NULL").select("doc_id", F.rlike("text", F.lit(MATCHES)).alias("matches"), F.char_length("text").alias("n"))
    ids = sampled(rows, "matches", "doc_id", sample).collect()  # 2 * sample rows at most
    taken: set[tuple[int, int]] = set()
    for with_match in (True, False):
        left = chars
        for r in sorted((r for r in ids if r.matches == with_match), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).digest(), r.n)):
            if r.n <= left:
                taken.add((r.doc_id, r.n))
                left -= r.n
    if not taken:
        return None
    found = texts(docs).where(F.col("doc_id").isin(*{i for i, _ in taken})).select("doc_id", "text").toLocalIterator(prefetchPartitions=True)
    kept: dict[tuple[int, str], None] = {}
    for r in found:
        if (r.doc_id, len(r.text)) in taken and len(kept) < 2 * sample:
            kept.setdefault((r.doc_id, r.text))
    return learn([text for _, text in sorted(kept)])


def scan(docs: DataFrame, field: Field | None, spans: str = "spans") -> DataFrame:
    """The rows of ``docs`` with ``spans``: array<struct<kind, start, end>>, in code
    points, by start, then kind (an input column of this name is replaced).

    Null and empty texts have no spans. Without a field only patterns are used.
    Each row is scanned on its own, so repeated rows and empty tables are
    nothing special.
    """
    sent = sent_to_workers(docs.sparkSession, field)

    def compute(batch: list[str]) -> list:
        tagger = kept_in_worker("secrets", sent, lambda f: f and Tagger(f))
        found = []
        for text in batch:
            base = base_spans(text)
            if tagger:
                base = sorted(base + tagger.added(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
            found.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
        return [found]

    return with_columns(docs, [(spans, ArrayType(SPAN))], compute)


MARK = "[SECRET]"


def redact(scanned: DataFrame, mark: str = MARK, spans: str = "spans") -> DataFrame:
    """The scanned rows with each span of ``text``, overlapping ones together,
    replaced by ``mark``, and n_chars, if there, counted anew. Nulls stay."""
    # Spans come by start: what each leaves uncovered since the greatest end so far is kept.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def take(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    out = F.when(F.size(spans) > 0, F.aggregate(spans, start, take, rest)).otherwise(F.col("text"))
    new = scanned.withColumn("text", out)
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in scanned.columns else new


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    found = scan(docs, fit(docs)).select("doc_id", "spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("crf").alias("n_crf"),
    )
