"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans are those of four fixed patterns. The field then reads a window of words around everything that may be personal
(digits, @, =, written-out "at" and "dot"): each run of up to LONGEST words is a candidate segment that is scored as a whole
(its shape, digits, checksum, the word before it), and dynamic programming over windows chooses boundaries and kinds jointly.
Its spans that touch no base span are added. It is trained once, on sentences made from templates by a fixed seed.

Defined results: a null text counts as empty; equal rows get equal results; very long texts are read whole, windows being
as long as they need and segments at most LONGEST words of any length; of segmentations that score alike the one with words
left alone, then with earlier kinds, is taken; an empty table gives no rows; further columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
LONGEST = 6
PIECE = 4 << 20  # bytes of text that are read at once, more only where one text has more
#: Beyond so many characters, spelt-out addresses are matched in time linear in the length.
BACKTRACK = 80
#: What a decoded segment's score must exceed, in nats over leaving its words alone.
MARGIN = 1.0

EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: a start at the run's first digit would match too.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MAY_HOLD = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    if not MAY_HOLD.search(text):
        return []
    out, last = [], 0
    for m in EMAIL_AT.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append((at, 0, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field ----

TRIGGER = re.compile(r"[0-9@=]|[\[(](?:at|dot)[\])]|(?<!\S)dot(?!\S)")
WORD = re.compile(r"\S+")
AROUND = 4
TRIM = "\"'`,;:!?()<>[]{}."
CUES = {"email": "email", "mail": "email", "e-mail": "email", "ip": "ip", "host": "ip", "address": "ip", "card": "card", "visa": "card", "phone": "phone", "call": "phone", "tel": "phone", "key": "secret", "token": "secret", "password": "secret", "secret": "secret"}
SHAPES = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    "spelt_email": re.compile(r"[\w.%+-]+ ?[\[(]?(?:at|AT)[\])]? ?[\w-]+(?: ?[\[(]?(?:dot|DOT)[\])]? ?[A-Za-z][\w-]*)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"),
    "spaced_card": re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}"),
    "phone": re.compile(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "hex": re.compile(r"[0-9a-f]{30,}"),
    "access_key": re.compile(r"A[KS]IA[0-9A-Z]{16}"),
    "assigned": re.compile(r"(?=\w++[=:][^\s=]{6,}\Z)(?i:\w*(?:password|passwd|secret|token|api_?key)\w*)[=:][^\s=]{6,}"),
    "words": re.compile(r"[^0-9@=]*"),
}


#: SHAPES["spelt_email"] as an automaton: from each state, (characters, next state), and the state reached without a character.
LOCAL_OF, WORD_OF = re.compile(r"[\w.%+-]").match, re.compile(r"[\w-]").match
LETTER_OF = re.compile(r"[A-Za-z]").match


def _chars(s: str):
    return frozenset(s).__contains__


STEPS = {
    0: [(LOCAL_OF, 1)], 1: [(LOCAL_OF, 1)], 2: [(_chars(" "), 3)], 3: [(_chars("[("), 4)], 4: [(_chars("a"), 5), (_chars("A"), 6)], 5: [(_chars("t"), 7)], 6: [(_chars("T"), 7)],
    7: [(_chars("])"), 8)], 8: [(_chars(" "), 9)], 9: [(WORD_OF, 10)], 10: [(WORD_OF, 10)], 11: [(_chars(" "), 12)], 12: [(_chars("[("), 13)], 13: [(_chars("d"), 14), (_chars("D"), 16)],
    14: [(_chars("o"), 15)], 16: [(_chars("O"), 17)], 15: [(_chars("t"), 18)], 17: [(_chars("T"), 18)], 18: [(_chars("])"), 19)], 19: [(_chars(" "), 20)], 20: [(LETTER_OF, 21)], 21: [(WORD_OF, 21)],
}
SKIPS = {1: 2, 2: 3, 3: 4, 7: 8, 8: 9, 10: 11, 11: 12, 12: 13, 18: 19, 19: 20, 21: 11}
SPELT = re.compile("(?:at|AT).*(?:dot|DOT)", re.DOTALL)


def spelt_email(s: str) -> bool:
    """Whether s has the shape spelt_email, in time that is linear in its length: the pattern tries every way to cut it at its
    "at"s and "dot"s, all states are followed at once here."""
    if not SPELT.search(s):
        return False
    now = {0}
    for c in s:
        new = set()
        for state in now:
            for holds, to in STEPS[state]:
                if holds(c):
                    while to not in new:
                        new.add(to)
                        if to not in SKIPS:
                            break
                        to = SKIPS[to]
        if not new:
            return False
        now = new
    return 21 in now


def shapes(s: str) -> list[str]:
    if len(s) <= BACKTRACK:
        return [k for k, p in SHAPES.items() if p.fullmatch(s)]
    return [k for k, p in SHAPES.items() if (spelt_email(s) if k == "spelt_email" else p.fullmatch(s))]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without quotes and marks around it; an opening bracket stays if its closing one does."""
    while end > start and text[end - 1] in TRIM and not (text[end - 1] in ")]" and re.search(r"[\[(](?:at|dot)$", text[max(start, end - 6) : end - 1])):
        end -= 1
    closing = text.rfind(")", start, end)
    while start < end and text[start] in TRIM and not (text[start] == "(" and start < closing):
        start += 1
    return start, end


def features(text: str, start: int, end: int, words: int, before: str) -> list[str]:
    """Of a whole segment."""
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    found = shapes(s)
    out = ["bias", f"words{words}", f"digits{next(k for k, most in enumerate((0, 3, 8, 11, 15, 19, 1 << 60)) if digits <= most)}", f"cue_{CUES.get(before, '-')}", *(f"is_{k}" for k in found), "formed" if found and found != ["words"] else "formless"]
    if "@" in s:
        out.append("at")
    if "card" in "".join(found):
        out.append("luhn" if luhn(NOT_DIGIT.sub("", s)) else "no_luhn")
    if "ip" in found:
        out.append("octets" if all(int(p) <= 255 for p in s.split(":")[0].split(".")) else "no_octets")
    return out


def segments(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, int, int, list[str]]]]:
    """For each end (a count of words): (begin, start, stop, features) of the candidate segments that end there."""
    out: list = [[]]
    for j in range(1, len(words) + 1):
        here = []
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
            start, end = trimmed(text, words[i][0], words[j - 1][1])
            # a segment begins in its first word and ends in its last
            if start < min(end, words[i][1]) and end > words[j - 1][0]:
                before = text[words[i - 1][0] : words[i - 1][1]].strip(TRIM).lower()[-12:] if i else ""
                here.append((i, start, end, features(text, start, end, j - i, before)))
        out.append(here)
    return out


class Field:
    """w[kind][feature], t[previous][next] with 0 for a word left alone; its score alone is 0."""

    def __init__(self):
        self.w: list[dict[str, float]] = [{} for _ in FOUND]
        self.t = [[0.0] * (len(FOUND) + 1) for _ in range(len(FOUND) + 1)]

    def scores(self, segs):
        """Segments with a score for each kind."""
        get = [w.get for w in self.w]
        return [[(i, a, b, f, [sum(g(x, 0.0) for x in f) for g in get]) for i, a, b, f in here] for here in segs]

    def best(self, segs) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation."""
        n, kinds, t = len(segs) - 1, range(len(FOUND) + 1), self.t
        top = [[-math.inf] * len(kinds) for _ in range(n + 1)]
        back: list = [[None] * len(kinds) for _ in range(n + 1)]
        top[0][0] = 0.0
        for j, here in enumerate(self.scores(segs)):
            if not j:
                continue
            for p in kinds:
                if (v := top[j - 1][p] + t[p][0]) > top[j][0]:
                    top[j][0], back[j][0] = v, (j - 1, p, None)
            for i, a, b, _, sc in here:
                for y, s in enumerate(sc, 1):
                    if s <= MARGIN:
                        continue
                    for p in kinds:
                        if (v := top[i][p] + t[p][y] + s - MARGIN) > top[j][y]:
                            top[j][y], back[j][y] = v, (i, p, (a, y - 1, b))
        j, p, out = n, max(kinds, key=lambda k: top[n][k]), []
        while j:
            j, p, seg = back[j][p]
            if seg:
                out.append(seg)
        return out[::-1]

    def gradient(self, segs, truth: set[tuple[int, int, int]]):
        """The log-likelihood of the true segmentation and its gradient by w and t: true counts less expected ones."""
        n, kinds, t = len(segs) - 1, range(len(FOUND) + 1), self.t
        scored = self.scores(segs)
        fwd = [[-math.inf] * len(kinds) for _ in range(n + 1)]
        bwd = [[-math.inf] * len(kinds) for _ in range(n + 1)]
        fwd[0][0] = 0.0
        add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs)) if xs and max(xs) > -math.inf else -math.inf
        for j in range(1, n + 1):
            fwd[j][0] = add([fwd[j - 1][p] + t[p][0] for p in kinds])
            for y in kinds[1:]:
                fwd[j][y] = add([fwd[i][p] + t[p][y] + sc[y - 1] for i, _, _, _, sc in scored[j] for p in kinds])
        bwd[n] = [0.0] * len(kinds)
        begins: dict = {}
        for j in range(1, n + 1):
            for i, _, _, _, sc in scored[j]:
                begins.setdefault(i, []).append((j, sc))
        for i in range(n - 1, -1, -1):
            for p in kinds:
                bwd[i][p] = add([t[p][0] + bwd[i + 1][0]] + [t[p][y] + sc[y - 1] + bwd[j][y] for j, sc in begins.get(i, []) for y in kinds[1:]])
        z = bwd[0][0]
        dw: list[dict[str, float]] = [{} for _ in FOUND]
        dt = [[0.0] * len(kinds) for _ in kinds]
        ends = {}
        for j in range(1, n + 1):
            for p in kinds:
                if fwd[j - 1][p] > -math.inf:
                    dt[p][0] -= math.exp(min(0.0, fwd[j - 1][p] + t[p][0] + bwd[j][0] - z))
            for i, a, b, f, sc in scored[j]:
                for y in kinds[1:]:
                    gain = 0.0
                    for p in kinds:
                        if fwd[i][p] > -math.inf:
                            m = math.exp(min(0.0, fwd[i][p] + t[p][y] + sc[y - 1] + bwd[j][y] - z))
                            dt[p][y] -= m
                            gain -= m
                    if (a, y - 1, b) in truth:
                        gain += 1
                        ends[j] = (i, y, sc[y - 1])
                    if abs(gain) > 1e-4:
                        for x in f:
                            dw[y - 1][x] = dw[y - 1].get(x, 0.0) + gain
        path, j = [], n
        while j:
            i, y, s = ends.get(j, (j - 1, 0, 0.0))
            path.append((y, s))
            j = i
        p, value = 0, 0.0
        for y, s in reversed(path):
            dt[p][y] += 1
            value += t[p][y] + s
            p = y
        return value - z, dw, dt

    def learn(self, segs, truth: set[tuple[int, int, int]], rate: float) -> None:
        """A step along the gradient."""
        _, dw, dt = self.gradient(segs, truth)
        for w, d in zip(self.w, dw, strict=True):
            for x, g in d.items():
                w[x] = w.get(x, 0.0) * (1 - 1e-4) + rate * g
        self.t = [[v * (1 - 1e-4) + rate * g for v, g in zip(row, d, strict=True)] for row, d in zip(self.t, dt, strict=True)]


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """Made-up words with made-up personal data among them, or with things that only look so."""
    letters = lambda n: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: letters(rng.randint(2, 9)) + rng.choice(["", "", "", ",", "."])
    host = lambda dot: dot.join([letters(5), rng.choice(["com", "org", "net"])])

    def card() -> str:
        d = rng.choice("45") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        name = letters(5) + rng.choice(["", ".", "_"]) + rng.choice(["", digits(2)])
        name = name.strip("._")
        return rng.choice([f"{name}@{host('.')}", f"{name} at {host(' dot ')}", f"{name} [at] {host(' [dot] ')}", f"{name}(at){host('(dot)')}"])

    make = {
        "email": email,
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)) + rng.choice(["", "", ":8080"]),
        "card": card,
        "phone": lambda: rng.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) 555-{digits(4)}", f"{digits(3)}-555-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}"]),
        "secret": lambda: rng.choice([hexes(40), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"password={hexes(18)}", f"api_key={letters(4)}{digits(8)}", hexes(32)]),
    }
    plain = [lambda: digits(rng.randint(1, 4)), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{letters(3)}{digits(2)}", lambda: f"{letters(1)}={digits(1)}", lambda: f"@{letters(6)}", lambda: digits(rng.randint(5, 11)), lambda: "dot", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(3)}9", lambda: f"{digits(4)} {digits(4)}"]
    text, spans = "", []
    for _ in range(rng.randint(4, 10)):
        roll = rng.random()
        if roll < 0.25:
            kind = rng.randrange(len(FOUND))
            if rng.random() < 0.3:
                text += rng.choice([c for c, k in CUES.items() if k == FOUND[kind]]) + rng.choice([": ", " "])
            value, quote = make[FOUND[kind]](), rng.choice(["", "", '"'])
            spans.append((len(text) + len(quote), kind, len(text) + len(quote) + len(value)))
            text += quote + value + quote + rng.choice(["", "", ".", ","]) + " "
        elif roll < 0.45:
            text += rng.choice(plain)() + " "
        else:
            text += word() + " "
    return text, spans


@cache
def trained(seed: int = 11, sentences: int = 400, rounds: int = 4) -> Field:
    rng, field = random.Random(seed), Field()
    made = [_sentence(rng) for _ in range(sentences)]
    cases = [(segments(text, [m.span() for m in WORD.finditer(text)]), set(spans)) for text, spans in made]
    for k in range(rounds):
        for segs, truth in cases:
            field.learn(segs, truth, 0.3 / (1 + k))
    return field


def windows(text: str):
    """Runs of words near a trigger; each is a list of (start, end). Two whose contexts meet are one, so that no entity straddles them."""
    now: list = []
    reach = 0
    m = TRIGGER.search(text)
    while m:
        at, gap = m.start(), []
        while at > reach and not text[at - 1].isspace():
            at -= 1
        begin = at
        for _ in range(AROUND + 1):
            end = begin
            while end > reach and text[end - 1].isspace():
                end -= 1
            if end == reach:
                break
            begin = end
            while begin > reach and not text[begin - 1].isspace():
                begin -= 1
            gap.append((begin, end))
        if len(gap) > AROUND:  # the window's end is out of reach
            if now:
                yield now
            now = []
            gap.pop()
        now += gap[::-1]
        left = AROUND + 1
        for w in WORD.finditer(text, at):
            now.append(w.span())
            left = AROUND if TRIGGER.search(text, *w.span()) else left - 1
            if not left:
                break
        reach = now[-1][1]
        m = TRIGGER.search(text, reach)
    if now:
        yield now


def spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and all: those of the field that touch none of them are added."""
    base = base_spans(text)
    found = list(base)
    starts, stops = [], []  # of what base spans cover
    for a, _, b in base:
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    for words in windows(text):
        for a, kind, b in field.best(segments(text, words)):
            k = bisect_left(starts, b)
            if not (k and stops[k - 1] > a):
                found.append((a, kind, b))
    return base, sorted(found)


def joined(found: list) -> str:
    return ",".join(f"{FOUND[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, found: list) -> str:
    """The text with every span replaced by its kind."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"<{FOUND[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the counts of base spans, base_sha256, spans, n_spans (of all), redacted."""
    held = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for b in batches:
            for part in pieces(b, 1, PIECE):
                cols: list = [[] for _ in range(8)]
                for text in part.column(1).to_pylist():
                    base, all_ = spans(text or "", held.value)
                    row = [*(sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), len(all_), redact(text or "", all_)]
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "redacted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("redacted")
