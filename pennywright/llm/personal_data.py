"""Personal data: fixed patterns, and a character tagger for the forms that they miss.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers; their spans always
stay.  The tagger (`char_tagger`, a bidirectional LSTM under a CRF) is trained from labelled spans
and adds spans such as `jan at mail dot example dot com` or `(578) 555-6437`.  It adds what reading
every window would: each plausible span holds a trigger (a digit, an at sign, or a written-out dot or
at), so windows with one are read first, and from each window with any span its neighbours are, until
no window that overlaps or touches such a one is unread.  Windows overlap by half; a
span that a window cuts is completed from its neighbours.  Of all spans of a text those
of the largest total score are taken, none overlapping another or one of the patterns.

Added spans must have the digits that their kind needs (a card's pass the Luhn test).

Labelled spans come as (text, spans) or, by default, from the patterns' own spans in a bounded
sample of the documents, each rewritten at random in forms that the patterns miss.  The
sample is at most SAMPLE documents in the order of a seeded hash; it is the same on every run.

Defined results: a null text counts as empty; texts without findings have empty lists; every row of
a repeated id gets its own result; positions are code points, ends exclusive.
"""

import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pennywright.llm.char_tagger import PAD, Tagger, character_ids

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
STRIDE = WINDOW // 2
SAMPLE = 1500  # documents that the tagger learns from
WINDOWS = 5000  # training windows made of them
PASSES, BATCH, RATE, SEED = 11, 48, 0.03, 11
BATCH_WINDOWS = 256  # decoded at once
LEAST_SCORE = 4.0  # log odds of an added span against none
LONGEST_JOIN = 4096  # characters of a span completed over windows

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match may start only where a run of digits does, so no run is read twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where a pattern is likely to match, for Spark's regular expressions.
_LIKELY = (r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9]|\+[0-9][ ().0-9-]{6}|[0-9]{13}"
           r"|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}")
#: Every plausible span holds one.  The last is a written-out at before a domain with a plain dot.
_TRIGGER = re.compile(r"(?i:[0-9@]|\bdot\b|[\[({<] ?(?:at|dot) ?[\])}>]"
                      r"| at(?= ++[\w-]++ ?(?:[\[({<] ?)?\.))")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses; works from each at sign, so long words are read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind in the order of KINDS and then by start."""
    out = [("email", *s) for s in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small_part, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text)
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def plausible(kind: str, span: str) -> bool:
    """Whether a tagged span has what its kind needs."""
    digits = digits_of(span)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and re.fullmatch(r"[-+0-9 ()./ ]+", span) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(
            r"[-0-9 ._/ ]+", span) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(map(_small_part, parts)) and re.fullmatch(
            r"[0-9]+(?:\W{0,3}(?:dot)?\W{0,3}[0-9]+){3}", span, re.I) is not None
    return re.fullmatch(
        r"[\w.%+-]+(?: ?\W? ?dot ?\W? ?[\w.%+-]+)*"
        r"(?: ?[\[({<]? ?@ ?[\])}>]? ?| ?[\[({<] ?at ?[\])}>] ?| +at +)"
        r"[\w-]+(?:(?: ?\. ?| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| +dot +)[\w-]+)+", span, re.I) is not None


# --- labelled windows

def _digits_anew(text: str, rng: random.Random) -> str:
    return re.sub("[0-9]", lambda m: str(rng.randrange(10)), text)


def _card_like(rng: random.Random) -> str:
    body = "".join(str(rng.randrange(10)) for _ in range(rng.choice([14, 15, 15, 15, 15])))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def variant(kind: str, span: str, rng: random.Random) -> str:
    """The span in another form of its kind; digits change, so that none are learnt by heart."""
    if kind == "email":
        local, _, domain = span.partition("@")
        if rng.random() < 0.7:
            local = "".join(rng.choice("aeiounrstlmkd") if c.isalpha() else c for c in local)
        if rng.random() < 0.3:
            domain = rng.choice(["gmail.com", "web.de", "post.example.org", "firma.fr", "mail.net",
                                 "uni.example.es", "corp.io"])
        form = rng.randrange(8)
        if form < 2:
            return f"{local}@{domain}"
        at = rng.choice([" at ", " [at] ", "[at]", "(at)", " (at) ", " @ ", "{at}", " AT ", "[@]"])
        dot = rng.choice([" dot ", " [dot] ", "[dot]", "(dot)", ".", " DOT ", "[.]", "."])
        if form == 2:
            local = local.replace(".", dot)
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([".", ".", "[.]", " . ", "(.)", "[dot]", " dot ", "(dot)", ". "]).join(parts)
    if kind == "card":
        digits = _card_like(rng)
        by = rng.choice(["", " ", "-", ".", "/", "_", " ", "  "])
        if len(digits) == 15:
            return by.join([digits[:4], digits[4:10], digits[10:]])
        return by.join(digits[i: i + 4] for i in range(0, len(digits), 4))
    span = _digits_anew(span, rng)
    a, b, c = (_digits_anew(x, rng) for x in ("555", "555", "5555"))
    country = rng.choice(["", "", "1-", "1 ", "001 ", "0049 ", "+1-", "+49 ", "1.", "+1."])
    return rng.choice([
        span, f"({a}) {b}-{c}", f"{country}{a}-{b}-{c}", f"{country}{a}.{b}.{c}", f"{country}({a}) {b}-{c}",
        f"({a}){b}-{c}", f"{country}{a} {b} {c}", f"0{a[:2]} {b}{c}", f"0{a}/{b}{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}",
        f"0{a[:1]} {c[:2]} {b[:2]} {a[1:]} {c[2:]}", f"00{a[:2]} {b} {c}", f"0{a}-{b}{c}"])


def _decoy(rng: random.Random) -> str:
    """A number or phrase that is no personal data."""
    d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    day, month, year = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1900, 2035)
    return rng.choice([
        f"{year}", f"{year}-{month:02d}-{day:02d}", f"{day}/{month}/{year}", f"{day:02d}.{month:02d}.{year}",
        f"{d(2)}:{d(2)}", f"{year}-{month:02d}-{day:02d} {d(2)}:{d(2)}:{d(2)}", f"${d(2)},{d(3)}.{d(2)}",
        f"{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(1)}.", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}",
        f"{d(3)}", f"{d(5)}", f"{d(6)}", f"{d(8)}", f"{d(12)}", f"no. {d(4)}", f"{d(1)},{d(3)},{d(3)}", f"{d(4)}-{d(4)}",
        f"{year}-{year + 3}", f"pp. {d(3)}-{d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(2)} %", f"#{d(4)}",
        f"§ {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)} {d(3)} {d(3)}", f"{d(2)}.{d(6)}, {d(2)}.{d(6)}", f"{d(4)}x{d(4)}",
        f"{d(1)}e-{d(2)}", f"0x{d(8)}", "%032x" % rng.getrandbits(128), "%020x" % rng.getrandbits(80),
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        "meet at noon", "at the dot", "dot and line", "look at it", "a dot", "@ home", "@name", "at 10 am",
        "the dot com bubble", f"id={d(10)}", f"{d(20)}", f"{d(24)}", f"{d(2)}-{d(2)}-{d(2)}",
        f"{d(1)}) {d(1)}) {d(1)})", f"{d(2)}, {d(2)}, {d(2)}, {d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}"])


def training_windows(labelled: list[tuple[str, list[tuple[str, int, int]]]], windows: int = WINDOWS,
                     seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and tags of windows of the texts: spans in new forms, decoys, plain places."""
    rng = random.Random(seed)
    labelled = [(t, sorted(s, key=lambda x: x[1:])) for t, s in labelled if t]
    if not labelled:
        return np.zeros((0, WINDOW), np.int16), np.zeros((0, WINDOW), np.int8)
    by_kind = {k: [] for k in KINDS}
    for t, spans in labelled:
        for k, i, j in spans:
            by_kind[k].append(t[i:j])
    kinds = [k for k in KINDS if by_kind[k]]
    ids = np.full((windows, WINDOW), PAD, np.int16)
    tags = np.zeros((windows, WINDOW), np.int8)
    for w in range(windows):
        t, spans = labelled[w % len(labelled)]
        cut = rng.randrange(len(t) + 1)
        for _, i, j in spans:  # never inside a span
            if i < cut < j:
                cut = j
        pieces = [(t[max(0, cut - WINDOW): cut], [])]
        pieces[0] = (pieces[0][0], [(k, max(i, cut - WINDOW) - max(0, cut - WINDOW), j - max(0, cut - WINDOW))
                                    for k, i, j in spans if j <= cut and j > cut - WINDOW])
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            lead = rng.choice([" ", " ", " ", "", ": ", "\n", " (", ", ", "=", ' "'])
            if kinds and rng.random() < 0.62:
                k = rng.choice(kinds)
                span = variant(k, rng.choice(by_kind[k]), rng)
                if lead in ("", "=") and k == "email":
                    lead = " "
                pieces += [(lead if lead or not pieces[-1][0][-1:].isalnum() else " ", []),
                           (span, [(k, 0, len(span))])]
            else:
                pieces += [(lead or " ", []), (_decoy(rng), [])]
            pieces.append((rng.choice([" ", " ", " ", ". ", ", ", "\n", ") ", '" ', "; ", "."]), []))
            a = rng.randrange(len(t) + 1)
            some = t[a: a + rng.randrange(40)]
            pieces.append((some if not re.search("[0-9@]", some) else "und the", []))
        after = min((i for _, i, j in spans if i >= cut), default=len(t))
        pieces.append((t[cut: min(after, cut + WINDOW)], []))
        text, marks = "", []
        for piece, found in pieces:
            marks += [(k, len(text) + i, len(text) + j) for k, i, j in found]
            text += piece
        # the window lies anywhere around what was put in, so that it also cuts spans
        middle = rng.choice([i for _, i, _ in marks]) if marks and rng.random() < 0.8 else rng.randrange(len(text) + 1)
        start = max(0, min(middle - rng.randrange(WINDOW), len(text) - WINDOW))
        some = character_ids(text[start: start + WINDOW])
        ids[w, : len(some)] = some
        for k, i, j in marks:
            first = 2 * KINDS.index(k) + 1
            i, j = i - start, min(j - start, WINDOW)
            if i < 0 < j:  # cut by the start: only further characters
                tags[w, :j] = first + 1
            elif 0 <= i < j:
                tags[w, i], tags[w, i + 1: j] = first, first + 1
    return ids, tags


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], windows: int = WINDOWS,
          passes: int = PASSES, seed: int = SEED) -> Tagger | None:
    """A tagger from labelled texts; None if they hold no spans."""
    if not any(s for _, s in labelled):
        return None
    ids, tags = training_windows(labelled, windows, seed)
    tagger = Tagger(len(KINDS)).start(seed)
    tagger.fit(ids, tags, passes, BATCH, RATE, seed)
    return tagger


def train_in_task(spark: SparkSession, labelled: list[tuple[str, list[tuple[str, int, int]]]],
                  **options) -> Tagger | None:
    """`train` as one Spark task: it can be run again elsewhere, and leaves the driver free."""
    def run(batches):
        for _ in batches:
            pass
        tagger = train(labelled, **options)
        weights = tagger.weights if tagger is not None else {}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(weights), pa.string()), pa.array([list(w.shape) for w in weights.values()], pa.list_(pa.int32())),
             pa.array([w.astype("<f4").tobytes() for w in weights.values()], pa.binary())],
            ["name", "shape", "data"])

    rows = spark.range(1, numPartitions=1).mapInArrow(
        run, "name string, shape array<int>, data binary").collect()  # seven arrays
    if not rows:
        return None
    return Tagger(len(KINDS), weights={
        r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r.shape) for r in rows})


def sample(docs: DataFrame, most: int = SAMPLE, seed: int = SEED) -> list[tuple[str, list]]:
    """At most `most` documents, two thirds of them with likely findings, with the patterns' spans.

    The documents are the first in the order of a seeded hash.  Of each the surroundings of its first
    likely finding, or of a place by hash, are taken: it is windows that the tagger learns from.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text", F.lit(seed))).withColumn(
        "at", F.regexp_instr("text", F.lit(_LIKELY)))
    near = F.when(F.col("at") > 0, F.col("at")).otherwise(F.pmod("place", F.length("text") + 1).cast("int"))
    low = F.greatest(near - 2 * WINDOW, F.lit(1))
    rows = rows.select("place", (F.col("at") > 0).alias("likely"),
                       F.substring("text", low, F.lit(6 * WINDOW)).alias("part"))
    found = []
    for likely, n in ((True, most * 2 // 3), (False, most - most * 2 // 3)):
        found += rows.filter(F.col("likely") == likely).orderBy("place", "part").limit(n).collect()
    out = []
    for r in found:
        part = re.sub(r"\A\S*\s|\s\S*\Z", "", r.part)  # whole words
        if part:
            out.append((part, sorted(base_spans(part), key=lambda s: s[1:])))
    return out


# --- decoding

def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a trigger; each place of a text lies in two windows."""
    tiles, at = set(), 0
    while m := _TRIGGER.search(text, at):
        tile = m.start() // STRIDE
        tiles.update((tile - 1, tile))
        at = (tile + 1) * STRIDE
    return [t * STRIDE for t in sorted(tiles) if t >= 0]


def _spans_in(tags: np.ndarray, e: np.ndarray, tagger: Tagger, start: int, size: int) -> list:
    """(kind, start, end, score, cut at the start, cut at the end) of one window's tags."""
    moves, first = tagger.moves()
    out, i = [], 0
    while i < size:
        if not tags[i]:
            i += 1
            continue
        kind, j = (tags[i] - 1) // 2, i + 1
        while j < size and tags[j] == 2 * kind + 2:
            j += 1
        path, none = 0.0, 0.0
        for p in range(i, j):
            path += float(e[p, tags[p]])
            none += float(e[p, 0])
            if p:
                path += float(moves[tags[p - 1], tags[p]])
                none += float(moves[tags[p - 1] if p == i else 0, 0])
            else:
                path, none = path + float(first[tags[p]]), none + float(first[0])
        out.append((int(kind), start + i, start + j, path - none, i == 0, j == size))
        i = j
    return out


def reconciled(spans: list, text: str) -> list[tuple[int, int, int]]:
    """Spans of overlapping windows as one set of spans without overlaps, of the largest total score.

    A span that its window cuts is completed by spans of its kind that overlap or touch it; one
    that another window shows whole gives way to it.  Only plausible spans of LEAST_SCORE compete.
    """
    size = len(text)
    complete, cut = {}, []
    for k, i, j, score, left, right in spans:
        if (left and i > 0) or (right and j < size):
            cut.append((k, i, j, score))
        else:
            complete[k, i, j] = max(score, complete.get((k, i, j), score))
    joined = []
    for k, i, j, score in sorted(cut, key=lambda s: s[:3]):
        last = joined[-1] if joined else None
        if last and last[0] == k and i <= last[2] and j - last[1] <= LONGEST_JOIN:
            joined[-1] = (k, last[1], max(j, last[2]), max(score, last[3]))
        else:
            joined.append((k, i, j, score))
    for k, i, j, score in joined:
        over = [s for s in complete if s[0] == k and s[1] < j and i < s[2]]
        if over and len(over) == 1 and over[0][1] <= i and j <= over[0][2]:
            continue
        low, high = min([i, *(s[1] for s in over)]), max([j, *(s[2] for s in over)])
        score = max([score, *(complete[s] for s in over)])
        complete[k, low, high] = max(score, complete.get((k, low, high), score))
    fit: dict[tuple, float] = {}
    for (k, i, j), score in complete.items():
        i, j = _to_words(text, i, j)
        if score >= LEAST_SCORE and not _inside_number(text, i, j) and plausible(KINDS[k], text[i:j]):
            fit[k, i, j] = max(score, fit.get((k, i, j), score))
    order = sorted(((k, i, j, s) for (k, i, j), s in fit.items()), key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in order]
    best, take = [0.0], []
    for n, (k, i, j, s) in enumerate(order):
        before = bisect_right(ends, i, 0, n)
        take.append((best[before] + s > best[n], before))
        best.append(max(best[n], best[before] + s))
    out, n = [], len(order)
    while n:
        taken, before = take[n - 1]
        if taken:
            out.append(order[n - 1][:3])
        n = before if taken else n - 1
    return out[::-1]


def _to_words(text: str, i: int, j: int, most: int = WINDOW) -> tuple[int, int]:
    """The span without outer white space, grown to whole words where it ends inside of one."""
    while i < j and text[i].isspace():
        i += 1
    while i < j and text[j - 1].isspace():
        j -= 1
    low, high = i - most, j + most
    while low < i and 0 < i < j and text[i - 1].isalnum() and text[i].isalnum():
        i -= 1
    while j < high and i < j < len(text) and text[j].isalnum() and text[j - 1].isalnum():
        j += 1
    if 0 < i and text[i - 1] == "(" and 0 <= text.find(")", i, j) and "(" not in text[i: i + 1]:
        i -= 1
    return i, j


def _inside_number(text: str, i: int, j: int) -> bool:
    """Whether digits go on beside the span, as in an ISBN's later half."""
    return (i > 1 and text[i - 1] in "-./,:" and text[i - 2].isdigit() and text[i].isdigit()) or (
        text[j: j + 1] in ("-", "/", ":") and text[j + 1: j + 2].isdigit())


def added_spans(texts: list[str], base: list[list], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger adds to those of the patterns, by text."""
    work = [(n, s) for n, t in enumerate(texts) for s in windows_of(t)]
    read = set(work)
    found: list[list] = [[] for _ in texts]
    at = 0
    while at < len(work):
        some = work[at: at + BATCH_WINDOWS]
        at += len(some)
        ids = np.full((len(some), WINDOW), PAD, np.int16)
        sizes = []
        for row, (n, s) in enumerate(some):
            part = character_ids(texts[n][s: s + WINDOW])
            ids[row, : len(part)] = part
            sizes.append(len(part))
        tags, e = tagger.decode(ids)
        for row in np.flatnonzero(tags.any(axis=1)):
            n, s = some[row]
            found[n] += _spans_in(tags[row], e[:, row], tagger, s, sizes[row])
            # spans of these windows may overlap or touch those
            for beside in (s - 2 * STRIDE, s - STRIDE, s + STRIDE, s + 2 * STRIDE):
                if 0 <= beside < len(texts[n]) and (n, beside) not in read:
                    read.add((n, beside))
                    work.append((n, beside))
    out = []
    for text, fixed, spans in zip(texts, base, found):
        taken = sorted((i, j) for _, i, j in fixed)
        starts = [i for i, _ in taken]
        reach = np.maximum.accumulate([j for _, j in taken]) if taken else []
        kept = []
        for k, i, j in reconciled(spans, text):
            before = bisect_right(starts, j - 1)
            if not before or reach[before - 1] <= i:
                kept.append((KINDS[k], i, j))
        out.append(kept)
    return out


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, text and arrays `base` and `added` of structs (kind, start, end) of every row."""
    if tagger is None:
        tagger = train_in_task(docs.sparkSession, sample(docs))
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def structs(spans):
        return [[{"kind": k, "start": i, "end": j} for k, i, j in s] for s in spans]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, tagger) if tagger is not None else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(structs(base), span),
                 pa.array(structs(added), span)], ["doc_id", "text", "base", "added"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, text string, base {spans}, added {spans}")


def joined(spans) -> "F.Column":
    """kind:start:end of the spans, by kind in the order of KINDS and then by start."""
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(place, s["kind"]).alias("place"), s["start"].alias("start"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text, of every row.

    n_email, n_ip, n_card and n_phone count the patterns' spans, n_added those of the tagger.
    """
    found = find(docs, tagger).drop("text")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.size("added").cast("long").alias("n_added"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"))
