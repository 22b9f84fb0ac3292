r"""Secret scans: base patterns, and by grammar inference formats learned from labelled credentials.

The patterns give base spans: assign (whole match, keyword included), access and hex. A frequency prefix
tree over labelled credentials is folded into a probabilistic automaton: red and blue states merge where
their outgoing frequencies agree within a Hoeffding bound, recursively. Every run of token characters is a
candidate, whatever its length and characters: it is read from its start, from after each separator in it
and from wherever a learned prefix occurs, to a separator or the run's end, and scored by the log likelihood
under the automaton against a bigram model of ordinary tokens. From the left, the longest part that is above
limit for each symbol and above EVIDENCE in all is a `format` span; parts with a learned prefix come before
others. What is found once for a run is looked up for its repetitions.

Symbols are the first LITERAL characters as they are where many samples agree on them, and classes of
characters elsewhere, so prefixes of issuers and the shape of what follows both count.

Labels. A caller gives credentials and ordinary tokens; without, the table gives them: what the base
patterns find in it is labelled credential, other runs ordinary. They come from at most about MAX_ROWS rows
with a base span and as many of all rows (smallest hashes of the text), and are at most MAX_SAMPLES and
MAX_ORDINARY different tokens of up to MAX_TOKEN characters. So formats that no base span shows aren't learned.

Edge cases. Null or empty text: no spans. Very long texts and runs: whole. Ties: base spans of different
kinds may overlap and all stay; a format span that lies inside a base span adds nothing and is left out.
Without any labelled credential there are base spans only. Each row stands alone, so repeated rows get equal
spans, and null or repeated ids do no harm. An empty table gives no rows. Extra columns, whatever their
names, do no harm."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, materialize

# The patterns, least lengths and kinds of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]+")
SEPARATOR = re.compile(r"[^A-Za-z0-9]")
LITERAL, END = 4, "$"
#: Log likelihood ratios that a part must exceed: for each symbol, and in all (one ordinary token in 160,000).
LIMIT, EVIDENCE = 0.5, 12.0
#: What is learned from at most.
MAX_ROWS, MAX_SAMPLES, MAX_ORDINARY, MAX_TOKEN = 2000, 600, 6000, 256
#: Runs of up to so many characters are kept with what was found in them, so many of them; only speed depends on it.
CACHED, CACHE = 64, 400_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches. A run of hex or access characters is matched as a whole, so the
    least length can be in the pattern; an assignment that is too short still takes its place, so it can't."""
    out = [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def prefixes(samples: list[str]) -> set[str]:
    """Beginnings of up to LITERAL characters, and theirs, that more samples share than random characters would."""
    known, groups = set(), {"": samples}
    for k in range(1, LITERAL + 1):
        longer = defaultdict(list)
        for group in groups.values():
            found = Counter(x[:k] for x in group if len(x) >= k)
            for x in group:
                if found[x[:k]] >= max(math.sqrt(len(group)), len(group) / 20):
                    longer[x[:k]].append(x)
        known |= longer.keys()
        groups = longer
    return known


def symbol(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c


def symbols(token: str, known: set[str]) -> list[str]:
    """Characters of a known prefix, marked, then classes and END."""
    k = 0
    while k < min(LITERAL, len(token)) and token[: k + 1] in known:
        k += 1
    return ["'" + c for c in token[:k]] + [symbol(c) for c in token[k:]] + [END]


class Grammar:
    """A probabilistic automaton: next state and frequency for each state and symbol."""

    def __init__(self, samples: list[str], alpha: float = 0.05) -> None:
        self.known = prefixes(samples)
        whole = [x for x in self.known if not any(y != x and y.startswith(x) for y in self.known)]
        self.start = re.compile("(?=" + "|".join(map(re.escape, sorted(whole))) + ")") if whole else None
        self.next: list[dict[str, int]] = [{}]
        self.freq: list[dict[str, int]] = [defaultdict(int)]
        for token in samples:
            v = 0
            for c in symbols(token, self.known):
                self.freq[v][c] += 1
                if c not in self.next[v]:
                    self.next.append({})
                    self.freq.append(defaultdict(int))
                    self.next[v][c] = len(self.next) - 1
                v = self.next[v][c]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.cost = [{c: math.log(f / sum(x.values())) for c, f in x.items()} for x in self.freq]

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        seen = set()
        while stack:
            a, b = stack.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            na, nb = sum(self.freq[a].values()), sum(self.freq[b].values())
            for c in self.freq[a].keys() | self.freq[b].keys():
                if self._differ(na, self.freq[a].get(c, 0), nb, self.freq[b].get(c, 0)):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """The tree under b is added to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            for c, n in self.freq[b].items():
                self.freq[a][c] += n
                if c in self.next[b]:
                    if c in self.next[a]:
                        stack.append((self.next[a][c], self.next[b][c]))
                    else:
                        self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        # States inside prefixes stay apart, or what may follow a prefix could stand without one.
        inner = {v for v, x in enumerate(self.next) if any(len(c) > 1 for c in x)}
        red, known = [0], {0}
        while True:
            blue = min(((q, p, c) for p in red for c, q in self.next[p].items() if q not in known and c != END), default=None)
            if not blue:
                break
            q, p, c = blue
            for r in red:
                if not {r, q} & inner and self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
                known.add(q)
        self.states = red


class Ordinary:
    """A bigram model of ordinary tokens' symbols."""

    def __init__(self, samples: list[str], known: set[str]) -> None:
        self.known = known
        self.pair: dict[tuple[str, str], int] = defaultdict(int)
        self.one: dict[str, int] = defaultdict(int)
        for token in samples:
            s = symbols(token, known)
            for a, b in zip(["^", *s], s, strict=False):
                self.pair[a, b] += 1
                self.one[a] += 1

    def cost(self, a: str, b: str) -> float:
        return math.log((self.pair.get((a, b), 0) + 0.1) / (self.one.get(a, 0) + 7))


def values(text: str) -> tuple[list[str], list[str]]:
    """What the patterns label in a text: credentials, and the other runs."""
    base = base_spans(text)
    own = [text[a:b] for a, b, k in base if k] + [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    other, free = [], 0
    blocks = base[::-1]
    for m in CANDIDATE.finditer(text):
        while blocks and blocks[-1][0] < m.end():
            free = max(free, blocks.pop()[1])
        if m.start() >= free:
            other.append(m[0])
    return own, other


def labelled(docs: DataFrame, text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[list[str], list[str]]:
    """Credentials and ordinary tokens that the table itself labels."""
    rows = docs.select(docs[f"`{text_col}`"].alias("text")).where("text is not null").withColumn("k", F.xxhash64("text"))
    # The patterns, for the JVM's regular expressions; a row too many does no harm.
    shows = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]") | F.col("text").rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    n, total = rows.agg(F.count_if(shows), F.count(F.lit(1))).head()
    up_to = lambda n: F.col("k") <= min((1 << 63) - 1, int(min(1.0, max_rows / max(n, 1)) * (1 << 64)) - (1 << 63))
    sample = rows.where(up_to(total) | (up_to(n) & shows)).select("text")
    schema = pa.schema([("token", pa.string()), ("credential", pa.bool_())])

    def run(batches):
        for batch in batches:
            found: dict[str, bool] = {}
            for text in batch.column(0):
                own, other = values(text.as_py())
                found.update((x, found.get(x, False)) for x in other)
                found.update((x, True) for x in own)
            short = {x: y for x, y in found.items() if len(x) <= MAX_TOKEN}
            yield pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.bool_())], schema=schema)

    tokens = materialize(sample.mapInArrow(run, "token string, credential boolean").groupBy("token").agg(F.max("credential").alias("credential")), "tokens")
    some = lambda which, k: sorted(r["token"] for r in tokens.where(which).orderBy(F.xxhash64("token"), "token").limit(k).collect())
    return some("credential", MAX_SAMPLES), some("not credential", MAX_ORDINARY)


def train(credentials: list[str], ordinary: list[str]) -> tuple[Grammar, Ordinary]:
    grammar = Grammar(credentials)
    return grammar, Ordinary(ordinary, grammar.known)


def longest(run: str, a: int, stop: int, models: tuple[Grammar, Ordinary], limit: float, ahead: dict) -> int:
    """The last end up to stop, before a separator or at the run's end, of a part from a that scores above the limits;
    0 if there is none. What was never seen ends the search: no longer part has a likelihood worth naming.

    ahead: of states at places of the run, how much an end further on can add at most; it keeps long runs with many
    starts from being read again and again, and changes no result."""
    grammar, ordinary = models
    v, total, last, best, k, top, trail = 0, 0.0, "^", 0, 0, -math.inf, []
    for i in range(a, stop + 1):
        c = run[i] if i < len(run) else ""
        if i > a and not c.isalnum() and run[i - 1] != "." and END in grammar.cost[v]:
            value = total + grammar.cost[v][END] - ordinary.cost(last, END) - limit
            if value > 0 and value + limit * (i - a + 1) > EVIDENCE:
                best = i
            trail.append((None, value))
        if i - a > LITERAL:
            key = i, v, last
            if key in ahead and total + ahead[key] <= 0:
                top = total + ahead[key]
                break
            trail.append((key, total))
        if k == i - a < LITERAL and run[a : i + 1] in grammar.known:
            k, s = k + 1, "'" + c
        else:
            s = symbol(c)
        if i == stop or s not in grammar.cost[v]:
            break
        total += grammar.cost[v][s] - ordinary.cost(last, s) - limit
        v, last = grammar.next[v][s], s
    for key, value in reversed(trail):
        if key is None:
            top = max(top, value)
        else:
            ahead[key] = top - value
    return best


class Runs(dict):
    """The format spans inside runs of token characters, found when first asked for."""

    def __init__(self, grammar: Grammar, ordinary: Ordinary, limit: float = LIMIT) -> None:
        super().__init__()
        self.models, self.limit = (grammar, ordinary), limit

    def __missing__(self, run: str) -> tuple[tuple[int, int], ...]:
        found = tuple(sorted(self.find(run)))
        if len(run) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[run] = found
        return found

    def find(self, run: str) -> list[tuple[int, int]]:
        start, ahead, held = self.models[0].start, {}, []
        learned = [x.start() for x in start.finditer(run)] if start else []
        # Parts that begin as a learned format does come before others, which might only lead up to one.
        for starts in (learned, [0, *(x.end() for x in SEPARATOR.finditer(run))]):
            blocks, free = sorted(held, reverse=True), 0
            for i in starts:
                while blocks and blocks[-1][0] <= i:
                    free = max(free, blocks.pop()[1])
                stop = blocks[-1][0] if blocks else len(run)
                if free <= i < stop and (b := longest(run, i, stop, self.models, self.limit, ahead)):
                    held.append((i, b))
                    free = b
        return held

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Format spans of a text, but for those inside one of base, which are in order of their starts."""
        if not any(map(self.__getitem__, set(CANDIDATE.findall(text)))):
            return []
        out, i, reach = [], 0, -1
        for m in CANDIDATE.finditer(text):
            for a, b in self[m[0]]:
                a, b = a + m.start(), b + m.start()
                while i < len(base) and base[i][0] <= a:
                    reach = max(reach, base[i][1])
                    i += 1
                if b > reach:
                    out.append((a, b, 3))
        return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", credentials: list[str] | None = None, ordinary: list[str] | None = None, limit: float = LIMIT) -> DataFrame:
    """For each row: id and all spans, as (start, end, kind) in code points, end exclusive."""
    if credentials is None or ordinary is None:
        own, other = labelled(docs, text_col)
        credentials, ordinary = own if credentials is None else credentials, other if ordinary is None else ordinary
    models = docs.sparkSession.sparkContext.broadcast(train(credentials, ordinary) if credentials else None)
    source = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    schema = pa.schema([("id", arrow_type(source, "id")), ("spans", pa.list_(span))])

    def run(batches):
        runs = None if models.value is None else Runs(*models.value, limit)
        for batch in batches:
            found = []
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                both = sorted(base + runs.spans(t, base), key=lambda x: (x[0], x[2])) if runs is not None else base
                found.append([{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in both])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), pa.array(found, schema[1].type)], schema=schema)

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = scan(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def brute_formats(text: str, models: tuple[Grammar, Ordinary], limit: float = LIMIT) -> list[tuple[int, int]]:
    """Format spans from every part of every run, each scored on its own, for tests."""
    grammar, ordinary = models

    def ratio(part: str) -> float:
        v, total, last, syms = 0, 0.0, "^", symbols(part, grammar.known)
        for s in syms:
            if s not in grammar.cost[v]:
                return -math.inf
            total += grammar.cost[v][s] - ordinary.cost(last, s)
            v, last = grammar.next[v].get(s, -1), s
        return total if total > limit * len(syms) and total > EVIDENCE else -math.inf

    out = []
    for m in CANDIDATE.finditer(text):
        run, held = m[0], []
        learned = [i for i in range(len(run)) if grammar.start and grammar.start.match(run, i)]
        for starts in (learned, [i for i in range(len(run)) if i == 0 or not run[i - 1].isalnum()]):
            for i in starts:
                if any(a <= i < b for a, b in held):
                    continue
                stop = min([a for a, _ in held if a > i], default=len(run))
                ends = [j for j in range(i + 1, stop + 1) if (j == len(run) or not run[j].isalnum()) and run[j - 1] != "." and ratio(run[i:j]) > -math.inf]
                if ends:
                    held.append((i, ends[-1]))
        out += [(m.start() + a, m.start() + b) for a, b in sorted(held)]
    return out


def brute(doc_id, text: str | None) -> tuple:
    """The base columns of the query from the patterns as they are stated, for tests."""
    t, out = text or "", []
    for k, (pattern, least, group) in enumerate(((ASSIGN.pattern, 8, 2), (r"AKIA[A-Z0-9]+", 16, 0), (r"[0-9a-f]+", 32, 0))):
        found = re.finditer(pattern, t, (re.IGNORECASE | re.ASCII) if k == 0 else 0)
        out.append([(m.start(), m.end(), k) for m in found if len(m[group]) >= least])
    return doc_id, *(len(x) for x in out), hashlib.sha256(spell(sum(out, [])).encode()).hexdigest()
