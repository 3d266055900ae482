"""Personal data: exact rules, and a linear-chain conditional random field for what they miss.

The rules find mail addresses, IP addresses, card and phone numbers, leftmost and without overlap for each
kind; a match that fails its check (a part above 255, the card checksum, too few or many digits) is dropped
and not tried again in another way. Rule spans always stay.

The field labels the words of a line. A word's features are its shape (runs of digits by length, letters by
case), its marks, whether it is one of a few cue words, and the same of its neighbours. It is trained on
the driver from a small labelled table of at most ``LABELLED`` rows (a bound, checked): lines and their spans.
:func:`labelled` makes that table from lines written for it and a bounded sample of the corpus' own lines
with their rule spans. All texts are then decoded whole, by Viterbi over all lines of an Arrow batch at
once; a line of any length is one sequence. A decoded span is added if it meets no rule span.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows pass through in place,
whatever their ids or repeats; equal texts get equal spans; an added column replaces one of its name. A corpus
without lines to sample trains from the written ones alone.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablegraph.llm import words
from tablegraph.llm.frame import quoted, tuned

KINDS = ("email", "ip", "card", "phone")
# Bounds of the training: rows of the labelled table, sampled lines of either sort, characters of such a line.
LABELLED = 2000
SAMPLED = 300
LINE = 400

# The rules.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would fare as one that starts with the run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

CUES = (
    "at", "dot", "call", "tel", "phone", "telefon", "fax", "mobile", "dial", "ring", "handy", "teléfono", "téléphone",
    "mail", "email", "e-mail", "correo", "write", "contact", "courriel", "card", "visa", "karte", "tarjeta", "carte",
    "mastercard", "amex", "iban", "number", "nummer", "no", "ip", "host", "server", "address", "adresse",
    "login", "from", "order", "version", "section", "chapter", "page", "year", "token", "price", "total", "room",
)

#: Lines with spans in the form ``[[kind|text]]``, for forms that the rules don't know, and lines without.
WRITTEN = """
please write to [[email|anna dot keller at example dot org]] before Friday
contact me: [[email|j.smith(at)example.com]], thanks
mail [[email|maria [at] example [dot] net]] for the list
email: [[email|support@localhost]] or come by
schreiben Sie an [[email|info@büro.example]] bis Montag
correo: [[email|luis at example dot es]] gracias
courriel [[email|paul(at)example.fr]] merci
you can call [[phone|(243) 555-0126]] after six
call [[phone|555-0134]] now
tel [[phone|0301 555 0178]] or fax [[phone|0301 555 0179]]
phone: [[phone|243-555-0199]], ask for the desk
my mobile is [[phone|243.555.0143]] most days
Telefon [[phone|0049 30 5550 1234]] abends
ring [[phone|020 7946 0018]] and wait
teléfono [[phone|915 550 123]] por la tarde
téléphone [[phone|01 55 50 12 34]] demain
dial [[phone|1-800-555-0111]] toll free
her phone number [[phone|(0301) 5550177]] is new
card [[card|4539_1488_0343_6467]] was charged
visa [[card|4539.1488.0343.6467]] exp 09/29
carte [[card|3782/822463/10005]] acceptée
Karte [[card|4539·1488·0343·6467]] gesperrt
tarjeta [[card|4539/1488/0343/6467]] nueva
server [[ip|2001:db8::8a2e:370:7334]] is up
host [[ip|fe80::1ff:fe23:4567:890a]] replied
ip [[ip|2001:db8:0:1:1:1:1:1]] seen twice
address [[ip|2001:db8:85a3::7]] was blocked
the year 1998 and the year 2004 were dry
version 2.0.1 of the License, section 4.3
see chapter 12, page 305 of the book
order 4711-0815 of 2023-10-05 at 12:30:00
the price is 1,299.00 in total, 20 % off
we met at 5 in room 243 on 12/05/2021
at the end of the day the dot is on the page
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" was set
I call it a day and write from the server room
the number 1234567 is odd and 7654321 too
call me when the card is on the table
10.5 km in 42 min 37 s, number 17 of 230
ISBN 978-3-16-148410-0 and RFC 2119
Der Host und die Karte sind neu, Seite 12
la page 12 et la carte de la ville
el correo de la casa y la tarjeta
(1) first (2) second (3) third
"""


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Each at sign with the run of local characters before it and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        # What stands before this sign holds no other one, so no later match can need it.
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules, in order of start and kind."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def written_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def read_spans(text: str) -> list[tuple[int, int, int]]:
    parts = [x.rsplit(":", 2) for x in text.split(",") if x]
    return sorted((int(a), KINDS.index(k), int(b)) for k, a, b in parts)


# --- the field ---------------------------------------------------------------------------------------------

# States: outside, then the first word and the further words of each kind.
STATES = 1 + 2 * len(KINDS)
ALLOWED = np.ones((STATES, STATES), bool)
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = False
    ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
FIRST = np.array([s == 0 or s % 2 == 1 for s in range(STATES)])
NEVER = -1e4

RAW = words.byte_tables(b" \t\x0b\x0c\r", b"\n")[0], np.arange(256, dtype=np.uint8)
EDGES = "()[]{}<>\"'|.,;:!?"


def features(word: str) -> list[str]:
    """Names of what a word shows by its form; the word itself only if it is a cue."""
    core = word.strip(EDGES)
    runs = [(k, len(list(g))) for k, g in groupby(core, _sort_of)]
    shape = "".join(f"d{min(n, 20)}" if k == "d" else k for k, n in runs)
    digits = sum(c in "0123456789" for c in word)
    out = [f"shape {shape[:40]}", f"digits {min(digits, 20)}", f"end {word[-1] if word[-1] in EDGES else ''}",
           f"start {word[0] if word[0] in EDGES else ''}"]
    out += [f"mark {c}" for c in sorted(set(word) & set("@+.:-/()[]*_·,%=#")) if c in core or c in "()[]"]
    if core.lower() in CUES:
        out.append(f"cue {core.lower()}")
    if digits and digits == len(core):
        out.append("all digits")
    return out


def _sort_of(c: str) -> str:
    return "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c


def forms(distinct: pa.Array) -> pa.Array:
    """Words with their letters by case; cues stay, in lower case. A form has the features of its words."""
    cue = pc.is_in(pc.utf8_trim(pc.utf8_lower(distinct), characters=EDGES), pa.array(CUES, distinct.type))
    form = pc.replace_substring_regex(distinct, r"\p{Ll}+", "x")
    return pc.if_else(cue, pc.utf8_lower(distinct), pc.replace_substring_regex(form, r"\p{Lu}+", "X"))


class Lines:
    """Words of many lines as one stream: the code of each one's form, the edges of the lines, and the
    features of each form."""

    def __init__(self, texts: pa.Array, known: dict[str, int] | None = None):
        self.of, piece, flat = words.cut(texts, *RAW)
        new = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.starts, len(piece)))
        self.new = new
        names = known if known is not None else {}
        coded = flat.dictionary_encode()
        seen = forms(coded.dictionary).dictionary_encode()
        self.code = seen.indices.to_numpy()[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        self.size = len(seen.dictionary)
        rows, ids = [], []
        for i, form in enumerate(seen.dictionary.to_pylist()):
            found = features(form)
            got = [names.setdefault(f, len(names)) if known is None else names.get(f, -1) for f in found]
            ids += (got := [f for f in got if f >= 0])
            rows += [i] * len(got)
        self.names = names
        self.rows, self.ids = np.array(rows, np.int64), np.array(ids, np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Scores of all states for each word, from its own features and those of its neighbours."""
        own, before, after = (self._by_code(w) for w in weights)
        got = own[self.code]
        got[1:] += np.where(self.new[1:, None], 0, before[self.code[:-1]])
        got[:-1] += np.where(self.new[1:, None], 0, after[self.code[1:]])
        return got

    def _by_code(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, STATES), weight.dtype)
        for s in range(STATES):
            out[:, s] = np.bincount(self.rows, weight[self.ids, s], minlength=self.size)
        return out

    def gathered(self, d: np.ndarray, count: int) -> np.ndarray:
        """The gradient of the weights from that of the scores."""
        def by_code(code, part):
            out = np.zeros((self.size, STATES))
            np.add.at(out, code, part)
            got = np.zeros((count, STATES))
            np.add.at(got, self.ids, out[self.rows])
            return got

        inner = ~self.new[1:]
        return np.stack([
            by_code(self.code, d), by_code(self.code[:-1][inner], d[1:][inner]),
            by_code(self.code[1:][inner], d[:-1][inner])])

    def steps(self):
        """Lines by falling length, and for each step the places of the words of those that reach it."""
        order = np.argsort(-self.lengths, kind="stable")
        starts, lengths = self.starts[order], self.lengths[order]
        reach = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        return starts, lengths, reach


def expected(lines: Lines, scores: np.ndarray, moves: np.ndarray):
    """Log of the sum over all labellings, and the probabilities of states and moves."""
    starts, lengths, reach = lines.steps()
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.where(ALLOWED, np.exp(moves), 0)
    alpha, scale = np.zeros_like(e), np.ones(len(e))
    for t, n in enumerate(reach):
        at = starts[:n] + t
        got = e[at] * (FIRST if t == 0 else alpha[at - 1] @ move)
        scale[at] = got.sum(axis=1)
        alpha[at] = got / scale[at, None]
    beta, pairs = np.ones_like(e), np.zeros_like(moves)
    for t in range(len(reach) - 1, 0, -1):
        at = starts[: reach[t]] + t
        right = e[at] * beta[at] / scale[at, None]
        beta[at - 1] = right @ move.T
        pairs += move * (alpha[at - 1].T @ right)
    return np.log(scale).sum() + scores.max(axis=1).sum(), alpha * beta, pairs


class Field:
    """Trained weights: features by name, their scores for a word and its neighbours, and the moves."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights.astype(np.float32), moves.astype(np.float32)

    def decoded(self, texts: pa.Array) -> tuple[Lines, np.ndarray]:
        """The best state of each word, by Viterbi over all lines at once."""
        lines = Lines(texts, self.names)
        scores = lines.scores(self.weights)
        starts, lengths, reach = lines.steps()
        moves = np.where(ALLOWED, self.moves, np.float32(NEVER))
        back = np.zeros(scores.shape, np.uint8)
        last = scores[starts] + np.where(FIRST, np.float32(0), np.float32(NEVER))
        state = np.zeros(len(lines.code), np.uint8)
        final = np.empty_like(last)
        for t, n in enumerate(reach):
            at = starts[:n] + t
            if t:
                prior, best, came = last[:n], last[:n, :1] + moves[0], np.zeros((n, STATES), np.uint8)
                for s in range(1, STATES):
                    other = prior[:, s : s + 1] + moves[s]
                    better = other > best
                    best = np.where(better, other, best)
                    came[better] = s
                back[at] = came
                last = best + scores[at]
            final[:n] = last
        if len(starts):
            state[starts + lengths - 1] = final.argmax(axis=1)
        for t in range(len(reach) - 1, 0, -1):
            at = starts[: reach[t]] + t
            state[at - 1] = back[at, state[at]]
        return lines, state

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        """Decoded spans of the texts that have any, by place in the batch."""
        lines, state = self.decoded(texts)
        found = np.flatnonzero(state)
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not len(found):
            return out
        first_of = np.searchsorted(lines.of, np.arange(len(texts)))
        for t in np.unique(lines.of[found]).tolist():
            text = texts[t].as_py()
            at = [m.span() for m in WORD.finditer(text)]
            own = found[lines.of[found] == t] - first_of[t]
            spans: list[list[int]] = []
            for i in own.tolist():
                s = int(state[first_of[t] + i])
                kind = (s - 1) // 2
                if s % 2 == 0:
                    spans[-1][2] = at[i][1]
                else:
                    spans.append([at[i][0], kind, at[i][1]])
            cut = [trimmed(text, *s) for s in spans]
            out[t] = [s for s in cut if plausible(text[s[0] : s[2]], s[1])]
        return out


def trimmed(text: str, start: int, kind: int, end: int) -> tuple[int, int, int]:
    """Without punctuation at the ends; a bracket stays where its partner is inside."""
    pairs = {")": "(", "]": "[", "}": "{", ">": "<"}
    while start < end - 1 and text[start] in EDGES:
        partner = {v: k for k, v in pairs.items()}.get(text[start])
        if partner and partner in text[start:end]:
            break
        start += 1
    while end > start + 1 and text[end - 1] in EDGES:
        partner = pairs.get(text[end - 1])
        if partner and partner in text[start:end]:
            break
        end -= 1
    return start, kind, end


def plausible(text: str, kind: int) -> bool:
    """Whether a decoded span holds what its kind can't do without."""
    if kind == 0:
        return bool(re.search(r"(?i)@|[(\[]at[)\]]|\bat\b.*\bdot\b", text))
    digits = sum(c in "0123456789" for c in text)
    return digits >= 12 if kind == 2 else digits >= 6 if kind == 3 else text.count(":") >= 3 or text.count(".") >= 3


def trained(labelled_rows: DataFrame, rounds: int = 150, decay: float = 0.5, rate: float = 0.1) -> Field:
    """A field from ``text, spans``, by gradient steps on the penalised likelihood.

    The table has at most ``LABELLED`` rows; more are refused, as they would all come to the driver.
    """
    rows = sorted({(r.text or "", r.spans or "") for r in labelled_rows.limit(LABELLED + 1).collect()})
    if len(rows) > LABELLED:
        raise ValueError(f"more than {LABELLED} labelled rows")
    texts = pa.array([t for t, _ in rows], pa.large_string())
    lines = Lines(texts)
    truth = np.zeros(len(lines.code), np.int64)
    place = np.searchsorted(lines.of, np.arange(len(rows)))
    for t, (text, spans) in enumerate(rows):
        at = [m.span() for m in WORD.finditer(text)]
        for a, kind, b in read_spans(spans):
            inside = [i for i, (x, y) in enumerate(at) if x < b and a < y]
            for j, i in enumerate(inside):
                truth[place[t] + i] = 1 + 2 * kind + (j > 0)
    count = len(lines.names)
    inner = np.flatnonzero(~lines.new[1:]) if len(truth) else np.zeros(0, np.int64)
    seen = np.zeros((STATES, STATES))
    np.add.at(seen, (truth[inner], truth[inner + 1]), 1)
    params = [np.zeros((3, count, STATES)), np.zeros((STATES, STATES))]
    means, squares = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, rounds + 1):
        _, states, pairs = expected(lines, lines.scores(params[0]), params[1])
        d = -states
        d[np.arange(len(truth)), truth] += 1
        slopes = [lines.gathered(d, count), np.where(ALLOWED, seen - pairs, 0)]
        for p, g, m, q in zip(params, slopes, means, squares, strict=True):
            g -= decay * p
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return Field(lines.names, *params)


def written_rows() -> list[tuple[str, str]]:
    out = []
    for line in WRITTEN.strip().split("\n"):
        text, spans = "", []
        # A span ends with two brackets that no third one follows.
        for part in re.split(r"(\[\[\w+\|.*?\]\](?!\]))", line):
            if part.startswith("[["):
                kind, inner = part[2:-2].split("|", 1)
                spans.append((len(text), KINDS.index(kind), len(text) + len(inner)))
                text += inner
            else:
                text += part
        out.append((text, written_spans(spans)))
    return out


def labelled(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text, spans``: the written lines, and sampled lines of the corpus with their rule spans.

    Of short lines with an at sign or three digits, and of those without, the ``SAMPLED`` with the smallest
    hashes are taken. Copies of a line count once.
    """
    lines = docs.select(F.explode(F.split(quoted(text_col), "\n")).alias("text")).where(
        F.length("text").between(1, LINE))
    marked = F.col("text").rlike("@|[0-9]{3}")
    order = (F.xxhash64("text"), F.col("text"))
    picked = [lines.where(w).groupBy("text").agg(F.lit(1)).select("text").orderBy(*order).limit(SAMPLED)
              for w in (marked, ~marked & (F.pmod(F.xxhash64("text"), F.lit(64)) == 0))]
    sample = [r.text for p in picked for r in p.collect()]
    rows = written_rows() + [(t, written_spans(rule_spans(t))) for t in sample]
    return spark.createDataFrame(rows, "text string, spans string")


def found(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows without their text, with ``n_email, n_ip, n_card, n_phone, rule_spans, spans``."""
    spark = tuned(docs.sparkSession)
    added = [f"n_{k}" for k in KINDS]
    names = [c for c in docs.columns if c not in (*added, "rule_spans", "spans", text_col)]
    kept = docs.select(*[quoted(c) for c in names], quoted(text_col).alias("\ntext"))
    schema = StructType([
        *kept.schema.fields[:-1], *[StructField(c, LongType()) for c in added],
        StructField("rule_spans", StringType()), StructField("spans", StringType())])
    shared = spark.sparkContext.broadcast(field)  # a few thousand features

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(len(names)), "").cast(pa.large_string())
            decoded = shared.value.spans(texts)
            counts, rules, every = [], [], []
            for t, text in enumerate(texts.to_pylist()):
                own = rule_spans(text)
                more = [s for s in decoded.get(t, ()) if all(s[2] <= a or b <= s[0] for a, _, b in own)]
                counts.append([sum(k == i for _, k, _ in own) for i in range(len(KINDS))])
                rules.append(written_spans(own))
                every.append(written_spans(sorted({*own, *more})))
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            columns += [pa.array(rules, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)
