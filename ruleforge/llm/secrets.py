"""Secret scans by a linear-chain conditional random field (operator 10).

Tokens are tagged O, B or I (outside, begin, inside of a secret) from their shape, the neighbouring
words and features of the whole file; Viterbi gives the best tags.  The model is trained here, by
maximum likelihood on generated lines with known tags (a bounded, seeded sample; no corpus row).

Most tokens are plain words.  ``plain_reach()`` derives from the fitted weights alone how far a best path can
stay away from O over plain tokens: between two O's never, next to other tokens for fewer than K of them (a
path that does so longer is improved by O's).  So best paths fall apart at runs of 2 K - 1 plain tokens, and
only the other tokens with K - 1 plain neighbours on each side are decoded.  Plain words that follow a cue, a
setting sign or a quote count as other tokens.  If the weights give no K, every token is decoded; results are
the same (asserted in the tests).

Spans of fixed rules (assignments, access ids, hex strings; see RULES) always stay; the field's spans
are added where they do not lie inside of one.

Defined cases: null or empty text has no spans; a null doc_id stays null; repeated rows are scanned
each; other columns are ignored; an empty table gives no rows.  Very long texts are scanned whole, with the
tokens of undecided paths in memory only.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base rules, in the order in which equal starts are listed.
RULES = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
KINDS = (*RULES, "crf")
#: Any assignment holds one of these in its lower-cased text, and one of these signs.
_HINT = re.compile(r"passw|secret|token|api_?key")

#: The score of a step that cannot be.
NEVER = -1e6

SPANS = "array<struct<kind:string,start:long,end:long>>"
OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

TAGS = 3  # O, B, I
#: Words before a value that announce one; fixed values.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "credential", "credentials", "auth", "authorization", "bearer", "passphrase")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: A token that is not a plain word has one of these.
_MARK = re.compile(r"[0-9+/_=]|[a-z][A-Z]|[A-Za-z][-.]+[A-Za-z]")
#: In front of a plain word that counts as another token: a cue, a sign that sets a value, or a quote.
_LEAD = re.compile(rf"""(?:[:=>"'`(]|(?:{"|".join(sorted(CUES, key=len, reverse=True))})(?![A-Za-z_]))[\x20\t"'`(]*""", re.IGNORECASE)
_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

#: Features of a token by its shape; the first two are those of plain tokens.
SHAPES = ("word", "long_word", "short_number", "number", "dotted_number", "phone", "hex_short", "hex_long", "upper_digit", "mixed_short", "mixed_long", "path_or_name", "padded", "odd_case", "joined_words")
PLAIN = 2
BEFORE = ("cue", "cue_word", "setting_sign", "quote", "word", "other", "edge")
AFTER = ("quote", "word", "other", "edge")
FILE = ("has_cue", "signs", "digits")
LONG_WORD = 8


def shape(t: str) -> int:
    core = t.strip("=.-_")
    if not _MARK.search(t) or not core:
        return int(len(core) >= LONG_WORD)
    digits = sum(c.isdigit() for c in core)
    if re.fullmatch(r"[0-9]+", core):
        return 2 if len(core) < 10 else 3
    if re.fullmatch(r"[0-9]+([.,:/-][0-9]+)+", core):
        return 4
    if re.fullmatch(r"\+?[0-9-]+", core):
        return 5
    if digits and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        return 6 if len(core) < 16 else 7
    if re.fullmatch(r"[A-Z0-9]+", core) and digits and len(core) >= 16:
        return 8
    if digits >= 2 and re.search(r"[A-Za-z]", core) and not re.search(r"[/.]", core):
        return 9 if len(core) < 16 else 10
    if len(core) >= 24 and digits >= 3 and re.search("[A-Z]", core) and re.search("[a-z]", core):
        return 10
    if t.endswith("=") and len(core) >= 16 and digits:
        return 12
    if re.fullmatch("[A-Za-z]+", core):
        return 13 if len(core) >= 12 and len(re.findall("[a-z][A-Z]", core)) >= 2 else int(len(core) >= LONG_WORD)
    return 14 if len(core) >= 12 and re.fullmatch("[A-Za-z]+(?:[-._][A-Za-z]+)+", core) else 11


def before(text: str, start: int) -> int:
    """The class of what precedes: looks through quotes and blanks to a setting sign, and past it to a cue."""
    head = text[max(0, start - 40) : start]
    bare = head.rstrip(" \t")
    if not bare or bare.endswith("\n"):
        return 6
    unquoted = bare.rstrip("\"'`(")
    sign = unquoted.rstrip(" ")
    if sign.endswith((":", "=", ">")):
        word = re.search(r"([A-Za-z_]+)[\"']?\s*[:=>]+$", sign)
        return 0 if word and any(c in word[1].lower() for c in CUES) else 2
    last = re.search(r"([A-Za-z_]+)$", sign)
    if last and last[1].lower() in CUES:
        return 1
    return 3 if len(unquoted) < len(bare) else 4 if last else 5


def after(text: str, end: int) -> int:
    c = text[end : end + 1]
    if c in "\"'`" and c:
        return 0
    rest = text[end : end + 24].lstrip(" ,;.)")
    return 3 if not rest or rest[0] == "\n" else 1 if rest[0].isalpha() else 2


def file_features(text: str) -> np.ndarray:
    """Features of the whole text, each 0 to 1."""
    n = max(len(text), 1)
    signs = sum(text.count(c) for c in "=:{}\"'")
    return np.array([bool(_HINT.search(text.lower())), min(1.0, 20 * signs / n), min(1.0, 5 * len(re.findall("[0-9]", text)) / n)], float)


WIDTH = len(SHAPES) * (1 + len(FILE) + len(BEFORE)) + len(BEFORE) + len(AFTER)


def features(kind: int, prev: int, nxt: int, file: np.ndarray) -> np.ndarray:
    """Shape, what precedes, what follows, shape with each file feature, and shape with what precedes."""
    s, b, a, f = len(SHAPES), len(BEFORE), len(AFTER), len(FILE)
    x = np.zeros(WIDTH)
    x[kind] = x[s + prev] = x[s + b + nxt] = 1
    at = s + b + a
    x[at + kind * f : at + (kind + 1) * f] = file
    x[at + s * f + kind * b + prev] = 1
    return x


def parts(w: np.ndarray):
    """The weights by what they belong to: shape, before, after, shape x file, shape x before (each x tag)."""
    s, b, a, f = len(SHAPES), len(BEFORE), len(AFTER), len(FILE)
    cut = np.cumsum([s, b, a, s * f])
    own = np.split(w, cut)
    return own[0], own[1], own[2], own[3].reshape(s, f, TAGS), own[4].reshape(s, b, TAGS)


def score_table(w: np.ndarray, file: np.ndarray) -> list:
    """Scores of the tags of a file's tokens, by shape, before and after."""
    shape_, before_, after_, by_file, both = parts(w)
    table = (shape_ + np.einsum("sft,f->st", by_file, file))[:, None, None] + before_[:, None] + after_ + both[:, :, None]
    return table.tolist()


# ---------------------------------------------------------------- training


def _random_secret(r: random.Random) -> list[str]:
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    kind = r.randrange(10)
    alnum = alnum if kind != 4 else alnum + "0123456789" * 2
    if kind == 0:
        return [pick("0123456789abcdef", r.choice((24, 32, 40, 64)))]
    if kind == 1:
        return ["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "7"]
    if kind == 2:
        return [r.choice(("ghp_", "sk-", "xoxb-", "pk_live_")) + pick(alnum, r.randrange(24, 40))]
    if kind == 3:
        return [pick(alnum + "+/", r.randrange(30, 60)) + r.choice(("", "=", "=="))]
    if kind == 4:
        return [pick(alnum, r.randrange(20, 40))]
    if kind == 5:  # several lines or words of one key
        return [pick(alnum + "+/", 64) for _ in range(r.randrange(2, 4))]
    if kind == 6:
        return [pick(alnum, r.randrange(8, 16)) + "9x2"]
    if kind == 7:  # letters of both cases
        return [pick(alnum[:52], r.randrange(20, 40)) + "aB"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == 8:
        return [r.choice("-._").join(pick(letters, r.randrange(4, 8)) for _ in range(r.randrange(3, 5)))]
    return [pick(letters, r.randrange(LONG_WORD, 16))]


def _training_text(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    word = lambda: "".join(r.choice(("an", "er", "tion", "the", "ou", "st", "ch", "ung", "ment", "en", "re", "é", "ó")) for _ in range(r.randrange(1, 5)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    harmless = (
        lambda: number(r.randrange(1, 9)), lambda: number(16), lambda: f"+{number(2)} (0){number(1)} {number(2)}-{number(2)}-{number(4)}",
        lambda: f"{word()}.{number(2)}@mail{number(1)}.example.org", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: f"{number(4)}-{number(2)}-{number(2)}",
        lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"https://www.example.org/{word()}/{number(4)}", lambda: f"{word()}_{word()}", lambda: f"{number(2)}:{number(2)}",
        lambda: f"{word()}***", lambda: f"{word()} = {number(3)}", lambda: f'{word()}: "{word()}"', lambda: f"#{number(6)}", lambda: f"{word()}/{word()}", lambda: f"ISBN {number(3)}-{number(10)}",
        lambda: f"{r.choice(CUES)} {word()}", lambda: f"{word()} {r.choice(CUES)}s {word()}", lambda: f"the {r.choice(CUES)} {word()} {word()}", lambda: f'"{word()}-{word()}"', lambda: f"{word()}-{word()}-{word()}",
        lambda: f"{r.choice(CUES)}: {word()[:6]}", lambda: f"{word().title()}{word().title()}", lambda: f"({word()}) {word()}", lambda: f"{word()}: {word()}{word()}", lambda: f"e.g. {word()}.{word()}",
    )
    text, spans = " ".join(word() for _ in range(r.randrange(0, 6))), []
    for _ in range(r.randrange(1, 4)):
        text += r.choice((" ", " ", "\n"))
        if r.random() < 0.5:
            secret = _random_secret(r)
            if secret[0].isalpha() and secret[0] != secret[0].lower() and r.random() < 0.4:
                text += r.choice(("Bearer ", "bearer ", "token "))
            elif len(secret) == 1 and (len(secret[0]) < 20 or not re.search("[0-9]", secret[0])) or r.random() < 0.7:
                text += r.choice(CUES) + r.choice((" = ", ": ", "=", " := ", "\": \"", " = \"", ": '", " => "))
            for i, s in enumerate(secret):
                text += r.choice((" ", "\n")) * bool(i)
                spans.append((len(text), len(text) + len(s), bool(i)))
                text += s
            text += r.choice(("", "\"", "'", ".", ","))
        else:
            text += r.choice(harmless)()
        text += " " + " ".join(word() for _ in range(r.randrange(0, 6)))
    return text, spans


def _training_set(n: int, seed: int, longest: int = 24):
    """n texts as padded arrays: features, tags and lengths."""
    r = random.Random(seed)
    x, y, size = np.zeros((n, longest, WIDTH), np.float32), np.zeros((n, longest), int), np.zeros(n, int)
    for i in range(n):
        text, spans = _training_text(r)
        file = file_features(text)
        tokens = list(TOKEN.finditer(text))[:longest]
        size[i] = len(tokens)
        for j, m in enumerate(tokens):
            x[i, j] = features(shape(m[0]), before(text, m.start()), after(text, m.end()), file)
            for a, b, inside in spans:
                if a < m.end() and m.start() < b:  # a token may hold its cue and sign as well
                    y[i, j] = 2 if inside or m.start() > a else 1
    return x, y, size


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(2)
def train(n: int = 900, seed: int = 11, steps: int = 150, l2: float = 1e-4):
    """Weights (features x tags) and transitions (tags x tags) by forward-backward and Adam."""
    x, y, size = _training_set(n, seed)
    n, longest, _ = x.shape
    there = np.arange(longest) < size[:, None]
    w, t = np.zeros((WIDTH, TAGS)), np.zeros((TAGS, TAGS))
    t[0, 2] = -4.0  # inside never follows outside in the data
    first, second = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    gold = np.eye(TAGS)[y] * there[..., None]
    pairs = there[:, 1:]
    gold_pairs = np.einsum("nla,nlb->ab", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    flat = x.reshape(-1, WIDTH)
    for step in range(1, steps + 1):
        e = (flat @ w.astype(np.float32)).reshape(n, longest, TAGS).astype(float)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for j in range(1, longest):
            new = _log_sum(alpha[:, j - 1, :, None] + t, 1) + e[:, j]
            alpha[:, j] = np.where(there[:, j, None], new, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = _log_sum(t + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(there[:, j + 1, None], new, 0)
        total = _log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * there[..., None]
        both = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        gw = flat.T @ (gold - p).reshape(-1, TAGS).astype(np.float32) / n - l2 * w
        gt = (gold_pairs - (both * pairs[..., None, None]).sum((0, 1))) / n - l2 * t
        for k, (value, g) in enumerate(((w, gw), (t, gt))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            value += 0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    t[0, 2] = NEVER  # an I needs a B or I before it
    return w, t


def plain_reach(w: np.ndarray, t: np.ndarray) -> tuple[frozenset[int], int | None]:
    """The classes of `before` in which a plain token may be other than O between O's, and the least K such that
    a best path stays away from O over fewer than K plain tokens of the other classes in a row; K is None where
    the weights do not show one.  File features lie between 0 and 1."""
    shape_, before_, after_, by_file, both = parts(w)
    scores = shape_[:PLAIN, None, None] + before_[:, None] + after_ + both[:PLAIN, :, None]  # shape, before, after, tag
    over = lambda tag, other: (scores[..., tag] - scores[..., other] + np.minimum(by_file[:PLAIN, :, tag] - by_file[:PLAIN, :, other], 0).sum(1)[:, None, None]).min((0, 2))  # noqa: E731  least, by class
    margin = np.minimum(over(0, 1), over(0, 2))
    within = t[1:, 1:].max()  # best step between B and I
    best_out = max(t[1, 0], t[2, 0])
    # a stretch of plain tokens between O's: the first is B, each further one costs its margin and a step
    between = margin + 2 * t[0, 0] - t[0, 1] - best_out
    open_ = frozenset(np.flatnonzero((between <= 0) | (margin + t[0, 0] - within < 0)).tolist())
    closed = [c for c in range(len(BEFORE)) if c not in open_]
    if open_ - {0, 1, 2, 3} or not closed:  # such tokens are not found by what leads to them
        return open_, None
    step = margin[closed].min() + t[0, 0] - within
    change = min(0.0, over(1, 2)[closed].min())  # the last of them as B instead of I
    enter = min(t[a, 0] - max(t[a, x] for x in (1, 2)) for a in range(TAGS))
    leave = min(t[1, b] - max(t[x, b] for x in (1, 2)) for b in range(TAGS))
    fixed = margin[closed].min() + enter + leave + t[0, 1] - within + change  # one token, both ends, and the step back to B
    for k in range(2, 13):
        if fixed + (k - 2) * step > 0:
            return open_, k
    return open_, None


class Decoder:
    """Viterbi over a run of tokens between two O's (or the ends of the text, which count as O).  Paths are
    decided as soon as all of them agree, so that a run of any length needs little memory."""

    def __init__(self, t: list, found: list, every: int = 2048):
        self.t, self.found, self.every = t, found, every
        self.best, self.back, self.spans = None, [], []

    def add(self, a: int, b: int, scores) -> None:
        t = self.t
        if self.best is None:
            self.best = [t[0][x] + scores[x] for x in range(TAGS)]
        else:
            o, p, q = self.best
            best, back = [], []
            for x in range(TAGS):
                u, v, w = o + t[0][x], p + t[1][x], q + t[2][x]
                if u >= v and u >= w:
                    best.append(u + scores[x])
                    back.append(0)
                elif v >= w:
                    best.append(v + scores[x])
                    back.append(1)
                else:
                    best.append(w + scores[x])
                    back.append(2)
            self.best = best
            self.back.append(back)
        self.spans.append((a, b))
        if len(self.spans) >= self.every and len(self.spans) % self.every == 0:
            self._settle()

    def _settle(self) -> None:
        now, n = {0, 1, 2}, len(self.spans) - 1
        while n > 0 and len(now) > 1:
            now, n = {self.back[n - 1][x] for x in now}, n - 1
        if len(now) == 1:
            self._emit(n, now.pop())
            self.back, self.spans = self.back[n + 1 :], self.spans[n + 1 :]

    def _emit(self, n: int, tag: int) -> None:
        """Tags of tokens 0 to n, the last of them known."""
        tags = [tag]
        for i in range(n, 0, -1):
            tags.append(self.back[i - 1][tags[-1]])
        for (a, b), x in zip(self.spans, reversed(tags), strict=False):
            if x == 1:
                self.found.append([a, b])
            elif x == 2:
                self.found[-1][1] = b

    def close(self) -> None:
        if self.spans:
            end = [s + self.t[x][0] for x, s in enumerate(self.best)]
            self._emit(len(self.spans) - 1, end.index(max(end)))


def viterbi(scores, t, every: int = 2048) -> list[int]:
    """Best tags of a run."""
    found: list = []
    run = Decoder(np.asarray(t).tolist(), found, every)
    for i, s in enumerate(np.asarray(scores).tolist()):
        run.add(i, i + 1, s)
    run.close()
    tags = [0] * len(scores)
    for a, b in found:
        tags[a:b] = [1] + [2] * (b - a - 1)
    return tags


# ---------------------------------------------------------------- scanning


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _HINT.search(text.lower()):
        found += [("assign", m.start(), m.end()) for m in RULES["assign"].finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in RULES["access"].finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in RULES["hex"].finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _other_places(text: str):
    """Places, in order, that make the token that holds them, or starts there, another one than plain."""
    marks, leads = (m.start() for m in _MARK.finditer(text)), (m.end() for m in _LEAD.finditer(text))
    return heapq.merge(marks, leads)


def field_spans(text: str, w: np.ndarray, t: np.ndarray, open_: frozenset = frozenset(), k: int | None = None) -> list[tuple[int, int]]:
    """Secrets by the field: B I* spans, end exclusive.  open_ and k are those of plain_reach()."""
    table, found = None, []
    steps = t.tolist()
    run, waiting = None, []  # plain tokens that no run has taken yet
    places = _other_places(text) if k else iter(())
    place = next(places, None)

    def take(tokens):
        nonlocal table
        if table is None:
            table = score_table(w, file_features(text))
        for a, b in tokens:
            run.add(a, b, table[shape(text[a:b])][before(text, a)][after(text, b)])

    if k and place is None:
        return []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if k:
            while place is not None and place < a:
                place = next(places, None)
            if place is None or place >= b:
                waiting.append((a, b))
                if run is None:
                    if len(waiting) >= k:
                        del waiting[0]
                elif len(waiting) > 2 * (k - 1):  # an O is among them: the run ends
                    take(waiting[: k - 1])
                    run.close()
                    run, waiting = None, waiting[len(waiting) - k + 1 :]
                continue
        if run is None:
            run = Decoder(steps, found)
        take(waiting)
        take([(a, b)])
        waiting = []
    if run is not None:
        take(waiting)
        run.close()
    return [(a, b) for a, b in found]


def all_spans(text: str, w: np.ndarray, t: np.ndarray, open_: frozenset, k: int | None) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    more = [("crf", a, b) for a, b in field_spans(text, w, t, open_, k)]
    ends, reach = [s for _, s, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    # base spans go by start: one holds (a, b) if it starts by a and ends by b or later
    more = [x for x in more if not ((n := bisect.bisect_right(ends, x[1])) and reach[n - 1] >= x[2])]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@functools.lru_cache(1)
def _model():
    w, t = train()
    return w, t, *plain_reach(w, t)


def scan(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) as doc_id and spans, code points, end exclusive; with digest as OUT."""
    model = _model()  # fitted on the driver: a few thousand numbers

    def run(batches):
        for batch in batches:
            found = [all_spans(x.as_py() or "", *model) for x in batch.column(1)]
            if digest:
                base = [[s for s in f if s[0] != "crf"] for f in found]
                count = lambda kind: pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64())  # noqa: B023, E731
                columns = [batch.column(0), *map(count, RULES), pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string()), pa.array([_listed(f) for f in found], pa.string())]
                yield pa.record_batch(columns, names=[c.split()[0] for c in OUT.split(", ")])
            else:
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return _source(docs).mapInArrow(run, OUT if digest else f"doc_id long, spans {SPANS}")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; all other columns as they are."""
    model = _model()

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, a, b in all_spans(text, *model):
            if b > at:
                if a >= at:
                    out += [text[at:a], mark]
                at = b
        return "".join(out) + text[at:] if out else text

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(x.as_py()) for x in batch.column(i)], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
