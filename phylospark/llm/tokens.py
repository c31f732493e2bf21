"""Token counts with a whole-token shortcut, for a byte-level BPE with word ends in the tokenizers library's format.

Offline, every vocabulary string with the word end is merged from its characters; those that end as one token are
proven and broadcast (their number is bounded by the vocabulary). A text is cut at ASCII white space, which neither the
normaliser nor the splitting pattern ever joins across; each distinct chunk is normalised and split once per worker,
its pre-tokens that are proven count one without merging, and only the rest are merged. Strings of special tokens
inside a text are cut out first and count one each, as the library does by default.

Nulls: a null text is an empty one (no tokens); a null doc_id stays null. Repeated rows are counted each. Empty tables
give empty results. Columns other than doc_id and text are not read. Texts are counted whole.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from phylospark.llm import common as c
from phylospark.llm.bpe import Remembered


class Merger:
    """The merges of a tokenizer file and how many tokens they leave of a pre-token (in the byte-level alphabet)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""

    def symbols(self, token: str) -> list[str]:
        """What is left of a pre-token after all merges, the lowest rank first, the leftmost of equals first."""
        parts: list[str | None] = [*token[:-1], token[-1] + self.end]
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or rank((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := rank((parts[i], parts[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := rank((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (x, p))
        return [s for s in parts if s is not None]


def prove(path: str) -> frozenset[str]:
    """Pre-tokens that the merges make one token of."""
    own = Merger(path)
    ends = (v[: -len(own.end)] for v in own.vocab if v.endswith(own.end) and len(v) > len(own.end))
    return frozenset(token for token in ends if own.symbols(token) == [token + own.end])


def plain_rules(spec: dict) -> tuple[bool, str] | None:
    """Whether printable ASCII is lowered, and the pattern of its pre-tokens, as a tokenizer file has them; None if the
    file does more to such text than that."""
    steps = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    splits = spec.get("pre_tokenizer") or {"type": None}
    splits = splits["pretokenizers"] if splits["type"] == "Sequence" else [splits]
    harmless = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} for x in steps)
    if not harmless or [x["type"] for x in splits] != ["Split", "ByteLevel"] or "Regex" not in splits[0]["pattern"]:
        return None
    if splits[0]["behavior"] != "Removed" or not splits[0]["invert"] or splits[1]["add_prefix_space"] or splits[1]["use_regex"]:
        return None
    return any(x["type"] == "Lowercase" for x in steps), splits[0]["pattern"]["Regex"]


class Counter:
    """Tokens of a text, by chunks."""

    def __init__(self, path: str, proven: frozenset[str]) -> None:
        import regex
        from tokenizers import Tokenizer

        self.merger, self.proven = Merger(path), proven
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in self.merger.spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: Printable ASCII needs neither the normaliser's Unicode forms nor the byte alphabet.
        self.plain, rules = regex.compile(r"[!-~]*+").fullmatch, plain_rules(self.merger.spec)
        self.lower, self.pieces = rules[0] if rules else False, regex.compile(rules[1]).findall if rules else None
        self.token = Remembered(lambda t: 1 if t in proven else len(self.merger.symbols(t)), longest=48)
        self.chunk = Remembered(self.count_chunk, longest=64)

    def count_chunk(self, raw: bytes) -> int:
        text, n = raw.decode("utf-8"), 0
        if self.special and "<" in text:
            n = len(self.special.findall(text))
            parts = self.special.split(text) if n else [text]
        else:
            parts = [text]
        for part in parts:
            if self.pieces and self.plain(part):
                pieces = self.pieces(part.lower() if self.lower else part)
            else:
                pieces = (p for p, _ in self.split(self.normalise(part)))
            for p in pieces:
                n += self.token[p]
        return n

    def __call__(self, raw: bytes) -> int:
        return sum(map(self.chunk.__getitem__, raw.split()))


_LOADED: dict[str, Counter] = {}


def count(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row."""
    proven = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        own = _LOADED.get(path)
        if own is None:
            own = _LOADED[path] = Counter(path, proven.value)
        for batch in batches:
            raws = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, raws), pa.int64()), tokens := pa.array(map(own, raws), pa.int64()), pa.compute.greater(tokens, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), c.text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
