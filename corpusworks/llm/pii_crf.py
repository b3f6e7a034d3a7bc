"""Personal data: exact base patterns plus a linear-chain conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns and stay as they are. The CRF
adds what patterns can't see: people's names behind a title, street addresses, dates of birth,
account numbers, phones without a country sign, addresses with letters beyond a-z.
It labels all tokens of a text (runs of letters, runs of digits, single signs).

Features are word shapes: class and length of a token, of its neighbours and of both
together, the gaps around it, cue words (titles, street words, "born", "tel", ...) near it, the
digits and groups of the number run it stands in, and whether its chunk holds an ``@``.
All are small numbers taken by numpy for a whole batch of texts; a token's scores are sums
of table rows. The model is trained on a small labelled table of lines with inline marks
``[phone:030 1234567]`` (``examples``: made by rule from sentence patterns) on the driver;
its tables travel with the task.

Viterbi runs over stretches that could hold a span. Running sums give, for every token and kind, the
most that a span through it can add to a path; a token that no span of worth >= 0 passes is outside in
the best path, so decoding the stretches between such tokens gives exactly the labels of the whole
text, in linear time.

Added spans that touch a base span are dropped.

Defined cases: null or empty text = no spans; very long texts go by in the same arrays; repeated rows are scanned each; other
columns are kept, columns of the added names are replaced; an empty table stays empty.
Some 200 bytes are held for each token of an Arrow batch (a batch is one text at least).
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusworks.llm.bpe_codec import _schema, _with

KINDS = ("email", "ip", "card", "phone", "name", "address", "birth", "account")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# ------------------------------------------------------------- base patterns
# The base patterns of the contract. Look-behinds only keep the
# search linear: a match can't begin inside the run that it would extend over.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (own + doubled) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base spans, sorted."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ------------------------------------------------------------------ features
END = 0x110000              # stands between two texts
SCORED = 1 << 16            # tokens whose scores are held at once
CAUTION = 1.0               # log odds that a span must have beyond even
OTHER, LETTERS, DIGITS, SPACE = range(4)
_SIGNS = ".,-/()+@:#'&"
# cue words by class
_CUES = {
    "title": "mr mrs ms miss dr prof sir madam herr frau mme mlle monsieur madame señor señora sr sra don doña",
    "street": "street st road rd avenue ave lane ln drive square court boulevard blvd way rue calle plaza avenida "
              "straße strasse str weg allee platz gasse quai chemin",
    "month": "january february march april may june july august september october november december januar februar "
             "märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre décembre",
    "born": "born birth dob birthday birthdate geboren geburtsdatum né née naissance nacido nacida nacimiento",
    "account": "iban account acct konto kontonummer compte cuenta bic",
    "phone": "phone tel call fax mobile telefon telephone téléphone teléfono cell", "card": "card visa mastercard karte carte",
    "ip": "ip host server", "mail": "mail email", "number": "version page order id year isbn section license",
    "link": "de la le du des der den von van al el del", "no": "no nr number num nummer on am le el am"}
_CLASSES = ["none", *_CUES]


def _kind_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, whether a capital, and the small letter."""
    points = [chr(i) for i in range(0x110000)]
    kind = np.array([LETTERS if c.isalpha() else DIGITS if c.isdecimal() else SPACE if c.isspace() else OTHER for c in points]
                    + [OTHER], np.uint8)
    small = np.arange(0x110001)
    for i, c in enumerate(points):
        if c.isupper() and len(c.lower()) == 1:
            small[i] = ord(c.lower())
    return kind, small != np.arange(0x110001), small


_TABLES: list = []


def _tables():
    if not _TABLES:
        _TABLES.extend(_kind_table())
    return _TABLES


_FACTORS = np.random.default_rng(29).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hash(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the first 64 characters of each token."""
    width = np.minimum(sizes, 64)
    at = np.repeat(starts, width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    place = at - np.repeat(starts, width)
    with np.errstate(over="ignore"):
        product = _FACTORS[place] * points[at].astype(np.uint64)
        return np.add.reduceat(product, np.cumsum(width) - width) + sizes.astype(np.uint64)


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    words = {w: k for k, c in enumerate(_CLASSES) if k for w in _CUES[c].split()}
    hashes = np.array([_word_hash(np.array([ord(c) for c in w]), np.array([0]), np.array([len(w)]))[0] for w in words], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array(list(words.values()), np.int64)[order]


_CUE_HASHES, _CUE_CLASSES = _cue_table()
SHAPES = 14 + len(_SIGNS) + 1
SIZES = {"shape": SHAPES, "left": SHAPES, "right": SHAPES, "left_shape": SHAPES ** 2, "shape_right": SHAPES ** 2,
         "cue": len(_CLASSES), "cue1": len(_CLASSES), "cue2": len(_CLASSES), "cue_right": len(_CLASSES),
         "cue_word": len(_CLASSES) * SHAPES, "gaps": 9 * 4, "run": 6 * 8, "run_cue": 6 * len(_CLASSES), "chunk": 2 * SHAPES,
         "run_shape": 6 * SHAPES}


def _shift(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    out = np.full_like(x, fill)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, END behind each; starts, ends of all tokens; which are ENDs."""
    kinds, _, _ = _tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
    kind = kinds[points]
    begins = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]] | (kind == OTHER))
    ends = np.append(begins[1:], len(points))
    used = kind[begins] != SPACE
    starts, ends = begins[used], ends[used]
    return points, starts, ends, points[starts] == END


def features(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers of the features of every token."""
    kinds, capital, small = _tables()
    kind, sizes = kinds[points[starts]], ends - starts
    upper = np.add.reduceat(np.append(capital[points], False).astype(np.int64), np.stack([starts, ends], 1).ravel())[::2]
    first = capital[points[starts]]
    shape = np.full(len(starts), 13)
    word = kind == LETTERS
    shape[word] = np.select([upper[word] == 0, (upper[word] == 1) & first[word] & (sizes[word] == 1),
                             (upper[word] == 1) & first[word], upper[word] == sizes[word]], [0, 1, 2, 3], 4)
    number = kind == DIGITS
    shape[number] = 5 + np.searchsorted([2, 3, 4, 5, 6, 10, 14], sizes[number], side="right")
    for k, c in enumerate(_SIGNS):
        shape[(kind == OTHER) & (points[starts] == ord(c))] = 14 + k
    shape[last] = SHAPES - 1
    at = np.minimum(np.searchsorted(_CUE_HASHES, hashes := _word_hash(small[points], starts, sizes)), len(_CUE_HASHES) - 1)
    cue = np.where((_CUE_HASHES[at] == hashes) & word, _CUE_CLASSES[at], 0)
    gap = np.minimum(starts - np.append(0, ends[:-1]), 2)                  # no, one or more spaces before
    gap[_shift(last.astype(np.int64), 1, 1) > 0] = 2
    behind = _shift(gap, -1, 2)
    left, right = _shift(shape, 1, SHAPES - 1), _shift(shape, -1, SHAPES - 1)
    # the nearest word before, up to three tokens back, that is a cue
    back = [np.where(_shift(last.astype(np.int64), k, 1) > 0, 0, _shift(cue, k, 0)) for k in (1, 2, 3)]
    near = np.where(back[0] > 0, back[0], np.where(back[1] > 0, back[1], back[2]))
    # number runs: digits with signs between them
    inside = number | ((shape >= 14) & np.isin(points[starts], [ord(c) for c in "+()-./"]))
    opens = ~inside | ~_shift(inside, 1, False) | (gap == 2)
    run = np.cumsum(opens) - 1
    digits = np.bincount(run, weights=np.where(number, sizes, 0)).astype(np.int64)[run]
    groups = np.minimum(np.bincount(run, weights=number).astype(np.int64), 7)[run]
    length = np.searchsorted([1, 7, 10, 14, 20], digits, side="right")
    head = np.flatnonzero(opens)                                          # the cue before the run
    before = near[head][run]
    chunk = np.cumsum((gap > 0) | last) - 1
    holds = np.bincount(chunk, weights=points[starts] == ord("@"))[chunk] > 0
    return {"shape": shape, "left": left, "right": right, "left_shape": left * SHAPES + shape, "shape_right": shape * SHAPES + right,
            "cue": cue, "cue1": back[0], "cue2": back[1], "cue_right": np.where(_shift(last, -1, True), 0, _shift(cue, -1, 0)),
            "cue_word": near * SHAPES + shape, "gaps": (gap * 3 + behind) * 4 + np.minimum(kind, 3),
            "run": length * 8 + groups, "run_cue": length * len(_CLASSES) + before, "chunk": holds * SHAPES + shape,
            "run_shape": length * SHAPES + shape}


def scores(weights: dict[str, np.ndarray], feats: dict[str, np.ndarray], at: slice) -> np.ndarray:
    """Tokens x labels."""
    out = None
    for name, table in weights.items():
        part = table.take(feats[name][at], axis=0)
        out = part if out is None else np.add(out, part, out=out)
    return out


# ------------------------------------------------------------------ training
_MARK = re.compile(r"\[(" + "|".join(KINDS) + r"):(.*?)\]")

# Sentence patterns of the labelled table; spans to find are marked, everything else is outside.
# {N} capitalised word, {n} word, {d3} digits.
PATTERNS = """
we met [name:Mr. {N} {N}] {n} {n}|[name:Dr. {N} {N}] {n} the {n}|ask [name:Frau {N}] or {N}|[name:Mme {N} {N}], {n} {n}
{n} with [name:Prof. {N} {N}-{N}].|dear [name:Ms {N} {N}],|por [name:Sra. {N} {N}] {n}|[name:Herr {N} von {N}] {n}|to [name:Dr. {N}].
{N} {N} {n} the {n} of {N}.|the {N} and {N} {n} in {N}.|{N}. {N} {n} {n}|{n} {n}. {N} {n}, {n}|{N} {n} {n} {N} {n}.|{n} dr {n} st {n} la {n}
the {n} st {n} nd {n} th {n}|{n} le {n} de la {n} {N}|Mr {n} {n} sir {n} {n}|{N} der {n} von {n} am {n}|{n} don {n} way {n} {n} mai {n}
at [address:{d2} {N} Street], {N}|[address:{d1} {N} St.] is {n}|lives at [address:{d3} {N} {N} Road] {n}|in der [address:{N}straße {d2}] {n}
[address:{d2} rue de {N}], {N}|[address:Calle {N} {d1}] {n}|am [address:{N}er Weg {d2}], {n}|[address:{d4} {N} Avenue] and|ship to [address:{d2} {N} Ln.]
the street {n} {n} {d2} {n}|{d2} {n} {n} road {n}|on the road {n}. {N} {d1} {n}|{N} way {d3} of {n}|{d1} {N} {n} the {n}|a square {d2} by {d2}
born [birth:{d2}/{d2}/19{d2}] in {N}|DOB: [birth:19{d2}-{d2}-{d2}]|born on [birth:{d1} May 19{d2}] {n}|geboren am [birth:{d2}.{d2}.19{d2}]
date of birth [birth:March {d1}, 19{d2}]|née le [birth:{d1} juin 19{d2}] à {N}|nacido el [birth:{d2}/{d2}/20{d2}]|birthday: [birth:{d2}-{d2}-19{d2}]
on {d2}/{d2}/19{d2} we|since 20{d2}-{d2}-{d2} {n}|{d1} May 20{d2} {n}|am {d2}.{d2}.20{d2} {n}|born in {N}, {n}|of March {d1}, 19{d2} the|year 19{d2}-20{d2} was
IBAN [account:DE{d2} {d4} {d4} {d4} {d4} {d2}]|account no. [account:{d10}] {n}|Konto [account:{d7}] bei|iban: [account:FR{d2}{d10}{d10}]
account number [account:{d4}-{d4}-{d2}] {n}|cuenta [account:{d4} {d4} {d2} {d10}]|acct [account:{d9}] is|Kontonummer [account:{d10}]
on account of {d3} {n}|account {n} {d2} {n}|the account {n} of {N} {d4}|no {d2} of {d3}|number {d4} of {n}|order {d10} {n}|id {d10}{d6} of
call [phone:{d3}-{d3}-{d4}] now|phone [phone:({d3}) {d3} {d4}] {n}|tel [phone:0{d2} {d7}]|tel. [phone:0{d3}/{d6}] {n}|mobile [phone:0{d3} {d3} {d4}] or
fax [phone:{d3}.{d3}.{d4}]|fax ({d3}) in {n}|reach us [phone:({d3}) {d3}-{d4}] daily|telefon [phone:0{d2}/{d6}]|call [phone:+{d2} {d2} {d7}] {n}|tel: [phone:{d3} {d4} {d4}]
write [email:{n}.{n}@bü{n}.example.de] soon|mail [email:{n}ë@ex{n}ä.com]|from [email:{n}.{d2}@mail{d1}.example.net] {n}|@{n} said|meet @ {n}|price @ {d2} each|{n}@{n} is {n}
host [ip:{d2}.{d3}.1{d2}.1{d2}] is {n}|server [ip:1{d2}.{d2}.{d2}.{d2}] {n}|version {d1}.{d1} of {n}|version {d2}.{d2}.{d1}.{d1} {n}|section {d1}.{d1}.{d1} of
card [card:4{d3} {d4} {d4} {d4}] {n}|visa [card:4{d3}-{d4}-{d4}-{d4}]|the {d10}{d6} and|isbn 978-{d1}-{d2}-{d6}-{d1} {n}|1,{d3} and {d2} {d3} {n}
{n}### {n}$$$ {n}%%% {n}&&& {n}*** {n},### {n}.%%%|$$$ {n}$$$ the&&& {n}***|## {n} ## {n}|*** {n} *** {n} == {n} ==|{n}&&& {n}### of&&& {N}*** {n}%%%
{N} {N} {N} {N} {N} {N} {N} {N} {N} {N} {N} {N}|GNU {N} {N} License {n} {N} {N} {N}|{N}, {N}, {N} {N}, {N} {N} {N} {n}|{N} {N}. {N} {N} {N}, {N}
{n} {n} {n} {n}. {N} {n} {n}, {n} {n} {n}. {N} {n}|{N} {n} {N} {n} {N}. {N} {N} {n} {n} {N}.|The {N} {N} {N} {N} of the {N} {N} {N} {N} {N} and|{N}-{N} {N}/{N} {N}: {N} {N}
{n} {d4} {n} {d3} {n} {d2} {n}, {d1}|{d8} {n} {d9} {n} {d7}|({d3}) {n} {d8} {n}|{n} {d7}, {n} {d9}. {N} {d8}|{N} {d2} {N} {d3} {N}|{n} in {d4}, {N} {d2}
La. {N} {n}|De. {N} {n} la|Der. {N}|Le. {N} {n}|Am. {N} {n}|Von. {N}|The. {N} {n}|El. {N} {n}|{n} de. {N} {n}|{n} der. {N}, {n}|{n} st. {N} {n}|St {n}. {N} {n}
{d2} {d3} {d3} {d2} {d1}|{d1} ({d2}) {d2} - {d2} / {d2}|about {d1}.{d5} or {d1}.{d5}|{d10}{d10}{d4}|page {d2}-{d2} and {d2}|License {d1}.{d1} or {d1}.{d1}
{n} {n} {n}, {n} {n} {n}. {N} {n} {n}.|{N} {n} {N} {N}, {n} {n}.|{n}: {n} - {n} ({n}) {n}/{n}|{n} {d1} {n} {d2} {n} {d4}|log 20{d2} {d2} {d2} {n}|{N}, {N} {d2}
"""
_SLOT = re.compile(r"\{(N|n|d)(\d*)\}")
_PARTS = "ba re lin to ka mor der sen ti ul va gre os mi pel dan ro ise ach we nu fo hal ster ing ont"


def example_lines(copies: int = 2, seed: int = 17) -> list[tuple[str, str]]:
    """(text, marked text) of every pattern, ``copies`` times with other words and digits."""
    r, parts = random.Random(seed), _PARTS.split()

    def fill(m):
        if m[1] == "d":
            return "".join(r.choice("0123456789") for _ in range(int(m[2])))
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
        return w.capitalize() if m[1] == "N" else w

    out = []
    for pattern in (p for line in PATTERNS.strip().splitlines() for p in line.split("|")):
        for _ in range(copies):
            marked = _SLOT.sub(fill, pattern)
            out.append((_MARK.sub(r"\2", marked), marked))
    return out


def examples(spark) -> DataFrame:
    """The default labelled table: text, marked (the text with marks)."""
    return spark.createDataFrame(example_lines(), "text string, marked string")


def _gold(marked: str) -> list[tuple[int, int, int]]:
    spans, shift = [], 0
    for m in _MARK.finditer(marked):
        start = m.start() - shift
        shift += len(m[0]) - len(m[2])
        spans.append((start, KINDS.index(m[1]), start + len(m[2])))
    return spans


def _allowed() -> np.ndarray:
    """-inf where I-kind follows anything but B- or I- of its kind."""
    n = len(LABELS)
    ok = np.zeros((n + 1, n))                      # last row: start of the chain
    for j, to in enumerate(LABELS):
        for i in range(n + 1):
            if to[0] == "I" and (i == n or LABELS[i][1:] != to[1:]):
                ok[i, j] = -np.inf
    return ok


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.sum(np.exp(x - top), axis=axis))


def train(labelled: DataFrame | list, rounds: int = 50, step: float = 0.4, penalty: float = 0.01, limit: int = 20_000,
          caution: float = CAUTION):
    """Fit the CRF by gradient steps (Adagrad) on the log-likelihood of at most
    ``limit`` labelled lines, all lines in one padded batch, then add ``caution`` to the score of "outside". Returns (weights by
    feature, transitions)."""
    if not isinstance(labelled, list):
        labelled = [(r[0], r[1]) for r in labelled.select("text", "marked").limit(limit).collect()]
    lines = [(t, m) for t, m in labelled if t and m and t.strip()]
    points, starts, ends, last = tokens_of([t for t, _ in lines])
    feats = features(points, starts, ends, last)
    line = np.cumsum(last) - last
    shift = np.cumsum([0, *(len(t) + 1 for t, _ in lines)])
    tags = np.zeros(len(starts), np.int64)
    for k, (_, marked) in enumerate(lines):
        for a, kind, b in _gold(marked):
            own = np.flatnonzero((line == k) & (starts >= shift[k] + a) & (ends <= shift[k] + b))
            tags[own] = 2 + 2 * kind
            tags[own[:1]] = 1 + 2 * kind
    own = np.flatnonzero(~last)
    line, tags, feats = line[own], tags[own], {f: v[own] for f, v in feats.items()}
    first = np.searchsorted(line, np.arange(len(lines)))
    place, lengths, n = np.arange(len(own)) - first[line], np.bincount(line, minlength=len(lines)), len(LABELS)
    most = int(lengths.max())
    live = np.arange(most)[None, :] < lengths[:, None]
    gold = np.zeros((len(lines), most, n))
    gold[line, place, tags] = 1
    ok = _allowed()
    moved = np.zeros_like(ok)
    np.add.at(moved, (n, tags[place == 0]), 1)
    np.add.at(moved, (tags[:-1][place[1:] > 0], tags[1:][place[1:] > 0]), 1)
    w, t = {f: np.zeros((SIZES[f], n)) for f in SIZES}, np.zeros((n + 1, n))
    gw, gt = {f: np.full_like(v, 1e-4) for f, v in w.items()}, np.full_like(t, 1e-4)
    for _ in range(rounds):
        e = np.zeros((len(lines), most, n))
        e[line, place] = scores(w, feats, slice(None))
        tr = t + ok
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = tr[n] + e[:, 0]
        for i in range(1, most):
            a[:, i] = np.where(live[:, i, None], _log_sum(a[:, i - 1, :, None] + tr[:n], 1) + e[:, i], a[:, i - 1])
        z = _log_sum(a[:, -1], 1)
        pairs = np.zeros((n, n))
        for i in range(most - 1, 0, -1):
            after = e[:, i] + b[:, i]
            p = np.exp(a[:, i - 1, :, None] + tr[:n] + after[:, None] - z[:, None, None])
            pairs += (p * live[:, i, None, None]).sum(0)
            b[:, i - 1] = np.where(live[:, i, None], _log_sum(tr[:n] + after[:, None], 2), 0)
        p = np.exp(a + b - z[:, None, None]) * live[:, :, None]
        wrong = (gold - p)[line, place]
        for f, v in w.items():
            d = -penalty * v
            for j in range(n):
                d[:, j] += np.bincount(feats[f], weights=wrong[:, j], minlength=SIZES[f])
            gw[f] += d * d
            v += step * d / np.sqrt(gw[f])
        d = moved - penalty * t
        d[:n] -= pairs
        d[n] -= p[:, 0].sum(0)
        gt += d * d
        t += step * d / np.sqrt(gt)
    w["shape"][:, 0] += caution
    return {f: v.astype(np.float32) for f, v in w.items()}, t + ok


# ------------------------------------------------------------------ decoding
CELLS = 200_000      # tokens of one padded batch


def viterbi(emissions: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """Best labels of each chain; chains of like length share a numpy batch."""
    n, out = transitions.shape[1], [None] * len(emissions)
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    at = 0
    while at < len(order):
        batch: list[int] = []
        while at < len(order) and (not batch or (len(batch) + 1) * len(emissions[order[at]]) <= CELLS):
            batch.append(order[at])
            at += 1
        lengths = np.array([len(emissions[i]) for i in batch])
        top, rows = int(lengths[-1]), np.arange(len(batch))
        padded = np.zeros((len(batch), top, n))
        for r, i in enumerate(batch):
            padded[r, :len(emissions[i])] = emissions[i]
        score = transitions[n] + padded[:, 0]
        back = np.zeros((len(batch), top, n), dtype=np.int8)
        for s in range(1, top):
            each = score[:, :, None] + transitions[None, :n]
            back[:, s] = each.argmax(1)
            score = np.where((s < lengths)[:, None], each.max(1) + padded[:, s], score)
        tag = score.argmax(1)
        tags = np.zeros((len(batch), top), dtype=np.int64)
        for s in range(top - 1, -1, -1):
            tags[:, s] = np.where(s < lengths, tag, 0)
            tag = np.where((s < lengths) & (s > 0), back[rows, s, tag], tag)
        for r, i in enumerate(batch):
            out[i] = tags[r, :lengths[r]]
    return out


def stretches(over: np.ndarray, last: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Tokens that some span of worth >= 0 passes. ``over``: tokens x labels but the first, scores over
    that of "outside". The worth of a span is what it adds to a path; where it touches another span
    the better way of counting the border is taken, so no span of the best path is worth less."""
    n, t = transitions.shape[1], transitions
    stay, out = t[0, 0], np.zeros(len(last), bool)
    at_end = np.append(last[1:], True)
    for b in range(1, n, 2):
        i = b + 1
        enter = max(t[0, b] - stay, t[n, b] - t[n, 0], np.max(t[1:n, b] - t[1:n, 0]))
        leave = max(np.max(t[[b, i], 0]) - stay, np.max(t[[b, i]][:, 1::2] - t[0, 1::2]))
        go_on = max(t[b, i], t[i, i]) - stay
        begin = np.where(last, -1e6, over[:, b - 1] + enter)
        total = np.cumsum(np.where(last, -1e6, over[:, i - 1] + go_on))
        upto = total + np.maximum.accumulate(begin - total)                    # best span so far, this token its last
        ends = total + np.where(at_end, max(leave, 0), leave)
        on = np.maximum.accumulate(ends[::-1])[::-1] - total                   # what going on can add
        out |= (upto + on + 1e-3 >= 0) & ~last
    return out


def crf_spans(texts: list[str], model) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind index, end) that the CRF finds in each text."""
    weights, transitions = model
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not any(texts):
        return found
    points, starts, ends, last = tokens_of(texts)
    feats = features(points, starts, ends, last)
    over = np.empty((len(starts), len(LABELS) - 1), np.float32)
    for k in range(0, len(starts), SCORED):
        e = scores(weights, feats, slice(k, k + SCORED))
        over[k:k + SCORED] = e[:, 1:] - e[:, :1]
    open_ = stretches(over, last, transitions)
    edge = np.diff(np.r_[0, open_.astype(np.int8), 0])
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text, shift = np.cumsum(last) - last, np.cumsum([0, *(len(t) + 1 for t in texts)])
    for k in range(0, len(first), 4096):
        runs = []
        for f, e in zip(first[k:k + 4096].tolist(), end[k:k + 4096].tolist()):
            f, e = f - (f > 0 and not last[f - 1]), e + (e < len(last) and not last[e])      # with the outside tokens next to it
            own = scores(weights, feats, slice(f, e)).astype(np.float64)
            own[~open_[f:e], 1:] = -np.inf
            runs.append((f, own))
        for (f, own), tags in zip(runs, viterbi([own for _, own in runs], transitions)):
            for i in np.flatnonzero(tags).tolist():
                tag, at = int(tags[i]), f + i
                t = int(text[at])
                a, b = int(starts[at] - shift[t]), int(ends[at] - shift[t])
                if tag % 2:
                    found[t].append((a, (tag - 1) // 2, b))
                else:
                    found[t][-1] = (found[t][-1][0], (tag - 1) // 2, b)
    return found


def all_spans(texts: list[str], model) -> list[tuple[list, list]]:
    """Base spans, and base plus added spans, of each text."""
    out = []
    for text, more in zip(texts, crf_spans(texts, model)):
        base = base_spans(text)
        added = []
        ends = np.maximum.accumulate([e for _, _, e in base]) if base else []
        starts = [s for s, _, _ in base]
        for s, k, e in more:
            i = int(np.searchsorted(starts, e))              # base spans that start before e
            if not (i and ends[i - 1] > s):
                added.append((s, k, e))
        out.append((base, sorted(base + added)))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def find_pii(df: DataFrame, text: str, labelled: DataFrame | None = None) -> DataFrame:
    """``df`` with ``pii``: array of (kind, start, end, base) by start, then kind;
    positions in code points, end exclusive."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(train(labelled if labelled is not None else examples(spark)))
    schema = _schema(df, [T.StructField("pii", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            rows = []
            for base, spans in all_spans(texts, shared.value):
                own = set(base)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in own} for s, k, e in spans])
            yield _with(b, {"pii": pa.array(rows, kind)})

    return df.mapInArrow(run, schema)
