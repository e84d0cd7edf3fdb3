"""Secret scans by grammar inference (ALERGIA).

Credentials that the three base patterns find label themselves.  A prefix tree
over them, one per kind, becomes a probabilistic automaton by merging states
whose outgoing and ending frequencies are statistically compatible (Hoeffding
bound), so the automaton generalises the format.  Every candidate token of
every text is then scored by its format likelihood under each automaton,
against a character model of the corpus's other candidate tokens: of all of them, but of plain
numbers for a number and of plain words for a word, so that these are no credentials; tokens above
both thresholds that no base match covers are added as spans of kind ``grammar``.
A candidate is a run of the credentials' alphabet, dots inside included, of the
length that an assigned value must have; where a run with dots fails as a whole, its parts
between dots are candidates.  A token that a base span only touches is scored.

Scale: two narrow passes over whole texts.  The shuffle between them holds the
distinct credentials only; character counts are one row per character and
task.  The automata are fitted on at most ``LEARN`` credentials per kind of at
most ``LONGEST`` characters (smallest hashes of all distinct ones), so what the
driver holds is bounded; everything is scored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import map_batches, query, stored, table

KINDS = ("assign", "access", "hex", "grammar")
LEARN = 600          # credentials per kind that the automata are fitted on
LONGEST = 128        # ... of this many characters at most
ALPHA = 0.05         # confidence of the merge test
THRESHOLD = 1.0      # nats per character over the corpus's own tokens
SHORTEST = 6         # characters of a candidate, as of an assigned value
EVIDENCE = 14.0      # nats in all: a corpus token passes by chance once in e^14 at most
CACHE = 1 << 17      # scored tokens that a task remembers
UNSEEN = 1e-4        # probability of a symbol that a state has not seen

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PART = r"[A-Za-z0-9+/_=-]"
TOKEN = re.compile(rf"{PART}+(?:\.+{PART}+)*")     # a sentence's last dot is not part of a token
DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MAKES = {"digits": DIGITS, "letters": LETTERS, "mixed": DIGITS + LETTERS + "+/_.=-"}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, rank of the kind, kind, end)`` of the base matches, in order of start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def credential(text: str, span: tuple[int, int, str, int]) -> str:
    """The secret itself: the value of an assignment, else the whole match."""
    s = text[span[0]:span[3]]
    return ASSIGN.match(s)[2] if span[2] == "assign" else s


def candidates(text: str, spans: list) -> list[tuple[int, int]]:
    """``(start, end)`` of the tokens of ``SHORTEST`` characters or more that no base span covers whole."""
    found = [m.span() for m in TOKEN.finditer(text) if m.end() - m.start() >= SHORTEST]
    if not spans:
        return found
    return [(s, e) for s, e in found if not any(x[0] <= s and e <= x[3] for x in spans)]


def make(token: str) -> str:
    """What a token is made of: a key of ``MAKES``."""
    return "digits" if token.isdigit() else "letters" if token.isalpha() else "mixed"


def parts(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """The runs between dots of the token at ``s:e``, if it has any dots."""
    if "." not in text[s:e]:
        return []
    return [(s + m.start(), s + m.end()) for m in re.finditer(r"[^.]+", text[s:e]) if m.end() - m.start() >= SHORTEST]


# ----------------------------------------------------------------- automata

class Automaton:
    """Frequency automaton: per state a visit count, an end count and symbol -> [target, count]."""

    def __init__(self):
        self.visits, self.ends, self.next = [0], [0], [{}]

    def _new(self) -> int:
        self.visits.append(0)
        self.ends.append(0)
        self.next.append({})
        return len(self.visits) - 1

    def add(self, s: str, n: int = 1) -> None:
        q = 0
        self.visits[0] += n
        for ch in s:
            if ch not in self.next[q]:
                self.next[q][ch] = [self._new(), 0]
            edge = self.next[q][ch]
            edge[1] += n
            q = edge[0]
            self.visits[q] += n
        self.ends[q] += n

    def _close(self, a: int, na: int, b: int, nb: int, alpha: float) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
        return abs(a / na - b / nb) < bound

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether states a and b (b the root of a tree) may be the same state."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if not self._close(self.ends[a], na, self.ends[b], nb, alpha):
                return False
            for ch in self.next[a].keys() | self.next[b].keys():
                ea, eb = self.next[a].get(ch), self.next[b].get(ch)
                if not self._close(ea[1] if ea else 0, na, eb[1] if eb else 0, nb, alpha):
                    return False
                if ea and eb:
                    todo.append((ea[0], eb[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for ch, (t, n) in self.next[b].items():
                if ch in self.next[a]:
                    self.next[a][ch][1] += n
                    todo.append((self.next[a][ch][0], t))
                else:
                    self.next[a][ch] = [t, n]

    def infer(self, alpha: float = ALPHA) -> Automaton:
        """Merge compatible states, breadth first (ALERGIA), and return self."""
        red = {0: None}      # ordered
        while True:
            blue = next(((q, ch) for q in red for ch in sorted(self.next[q]) if self.next[q][ch][0] not in red), None)
            if blue is None:
                break
            q, ch = blue
            new = self.next[q][ch][0]
            same = next((r for r in red if self.compatible(r, new, alpha)), None)
            if same is None:
                red[new] = None
            else:
                self.next[q][ch][0] = same
                self.fold(same, new)
        keep = {r: i for i, r in enumerate(red)}
        out = Automaton()
        out.visits = [self.visits[r] for r in red]
        out.ends = [self.ends[r] for r in red]
        out.next = [{c: [keep[t], n] for c, (t, n) in self.next[r].items()} for r in red]
        return out

    def tables(self) -> list[tuple[float, dict]]:
        """Per state the log probability of ending and symbol -> (target, log probability)."""
        return [(math.log(max(e / v, UNSEEN)) if v else math.log(UNSEEN), {c: (t, math.log(n / v)) for c, (t, n) in x.items()})
                for v, e, x in zip(self.visits, self.ends, self.next)]


def log_likelihood(tables: list, s: str) -> float:
    """Log probability of ``s``; an unseen symbol costs ``UNSEEN`` and leaves the state as it is."""
    q, total, miss = 0, 0.0, math.log(UNSEEN)
    for ch in s:
        step = tables[q][1].get(ch)
        if step is None:
            total += miss
        else:
            q = step[0]
            total += step[1]
    return total + tables[q][0]


def fit(samples: dict[str, list[str]]) -> list:
    """Tables of one inferred automaton per kind that has samples."""
    out = []
    for kind in sorted(samples):
        a = Automaton()
        for s in sorted(samples[kind]):
            a.add(s)
        if samples[kind]:
            out.append(a.infer().tables())
    return out


def learn(src: DataFrame, limit: int) -> tuple[list, dict[str, dict[str, float]]]:
    """Automata of the base credentials, and log frequencies of characters in candidate tokens (all, numbers, words), over all texts."""

    def collect(b: pa.RecordBatch):
        found, chars, tokens = Counter(), Counter(), Counter()
        for text in b.column(0).to_pylist():
            if text:
                spans = base_spans(text)
                for s in spans:
                    if s[3] - s[0] <= 2 * LONGEST and len(c := credential(text, s)) <= LONGEST:
                        found[s[2], c] += 1
                tokens.update(text[s:e] for s, e in candidates(text, spans))
        for t, n in tokens.items():
            for kind in {make(t), "mixed"}:
                for c in t:
                    chars[kind, c] += n
        rows = [(k, v, n) for (k, v), n in (found + chars).items()]
        if rows:
            k, v, n = zip(*rows)
            yield {"kind": list(k), "value": list(v), "n": list(n)}

    seen = stored(map_batches(src.select("text"), collect, "kind string, value string, n long")
                  .groupBy("kind", "value").agg(F.sum("n").alias("n")), "secret-samples")
    samples = {}
    for kind in KINDS[:3]:
        samples[kind] = [r.value for r in seen.where(F.col("kind") == kind)
                         .orderBy(F.xxhash64("value"), "value").limit(limit).collect()]
    chars = {(r.kind, r.value): r.n for r in seen.where(F.col("kind").isin(*MAKES)).collect()}   # three alphabets at most
    plain = {}
    for kind, alphabet in MAKES.items():
        total = max(1, sum(chars.get((kind, c), 0) for c in alphabet))
        # half of it uniform, so that a rare character alone is no evidence
        plain[kind] = {c: math.log(0.5 * chars.get((kind, c), 0) / total + 0.5 / len(alphabet)) for c in alphabet}
    return fit(samples), plain


def scan(docs: DataFrame, limit: int = LEARN, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, a count per kind, ``base_sha256``, ``spans``,
    ``best_score`` (largest format likelihood of an added span, null without one).

    Spans are ``kind:start:end`` in code points, end exclusive.  Null and empty
    texts have no spans; null ids are passed on; repeated rows are scored
    alike; very long texts are scanned whole; without any labelled credential nothing is
    added to the base; an empty table gives an empty result, and other columns are ignored.
    """
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    automata, plain = learn(src, limit)

    known: dict[str, float] = {}

    def score(token: str) -> float:
        """Nats per character over the corpus's tokens; minus infinity without enough of them in all."""
        got = known.get(token)
        if got is None:
            chances = plain[make(token)]
            corpus = sum(chances[c] for c in token)
            nats = max((log_likelihood(a, token) for a in automata), default=-math.inf) - corpus
            if len(known) >= CACHE:
                known.clear()
            got = known[token] = nats / len(token) if nats >= EVIDENCE else -math.inf
        return got

    def added(text: str, spans: list):
        """``(start, end, score)`` of the tokens that pass, else of their parts that do."""
        for s, e in candidates(text, spans):
            if (got := score(text[s:e])) >= threshold:
                yield s, e, got
                continue
            for a, z in parts(text, s, e):
                if not any(x[0] <= a and z <= x[3] for x in spans) and (got := score(text[a:z])) >= threshold:
                    yield a, z, got

    def run(b: pa.RecordBatch):
        out = {x: [] for x in ("n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans", "best_score")}
        for text in b.column(0).to_pylist():
            spans = base_spans(text or "")
            n = Counter(s[2] for s in spans)
            base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
            best = None
            for s, e, got in list(added(text or "", spans)):
                spans.append((s, 3, "grammar", e))
                best = got if best is None else max(best, got)
            spans.sort()
            for k in ("assign", "access", "hex"):
                out[f"n_{k}"].append(n[k])
            out["n_grammar"].append(sum(x[1] == 3 for x in spans))
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans))
            out["best_score"].append(best)
        yield {"doc_id": b.column(1)} | out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_grammar long, "
                                 "base_sha256 string, spans string, best_score double")


@query("op1_grammar_secret_scan")
def op1(spark, sf_dir):
    """Secrets in every document."""
    return scan(table(spark, sf_dir, "documents"))
