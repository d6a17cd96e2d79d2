"""Chat formatting by schema fingerprints.

A record is one JSON object in any of several layouts (prompt and completion, instruction and output, lists of
messages). The set of its nested field paths, each with the kind of what it holds (a list, an object, or a value), is
hashed; the hash selects a declarative mapping that yields canonical turns. Turns are rendered in one template: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a control
string gets one backslash more after its first character (`<|im_end|>` becomes `<\\|im_end|>`, that becomes
`<\\\\|im_end|>`), which removing one undoes. The loss mask covers the rendered texts of assistant turns.

Formatting is by record, so a conversation of any length is never gathered; reading back streams over the sorted
segments of a partition and holds one conversation's digests only. One conversation is read back by one task, as its
digests run over its turns in order.

Defined cases: a null record, one that is no JSON object (also: nested too deep to read), or one whose typed paths no
mapping has (a list where a text should be, null for a list, items of mixed kinds), gives one row without segment and
a null layout; null texts and roles are empty, numbers and truth values are their JSON; half surrogates become U+FFFD;
an empty list of messages gives no turns; equal rows are formatted as often as they come; segments of equal order are
ordered by their text; texts of any length are formatted whole; keys and orders must be numbers or read as such; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- layouts ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list of messages (`each` with its role and text fields), or fixed fields
    per role. Fields in `optional` may be missing."""

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict = field(default_factory=dict, hash=False)
    optional: tuple[str, ...] = ()

    def path_sets(self) -> Iterator[frozenset[str]]:
        if self.each:
            need = {f"{self.each} list", f"{self.each}[] object", f"{self.each}[].{self.role} value", f"{self.each}[].{self.text} value"}
        else:
            need = {f"{f} value" for _, fs in self.turns for f in fs if f not in self.optional}
        for some in chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1)):
            if need or some:
                yield frozenset(need | {f"{f} value" for f in some})

    def apply(self, record: dict) -> list[tuple[str, str]]:
        said = lambda x: "" if x is None else whole(x) if isinstance(x, str) else json.dumps(x)
        first = [("system", said(record["system"]))] if self.each and "system" in record else []
        if self.each:
            return first + [(self.roles.get(said(m.get(self.role)), said(m.get(self.role))), said(m.get(self.text))) for m in record[self.each]]
        return [(role, "\n\n".join(said(record[f]) for f in fs if f in record)) for role, fs in self.turns if any(f in record for f in fs)]


MAPPINGS = (
    Mapping("messages", each="messages", role="role", text="content", optional=("system",)),
    Mapping("conversations", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}, optional=("system",)),
    Mapping("dialog", each="dialog", role="speaker", text="utterance", optional=("system",)),
    Mapping("prompt", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system", "prompt", "completion")),
    Mapping("response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "instruction", "input", "output")),
    Mapping("question", turns=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)


def whole(text: str) -> str:
    """text as UTF-8 can hold it: half surrogates, which JSON can name, become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def field_paths(value: object) -> set[str]:
    """Nested field paths, each with the kind of what it holds; list items share one path with []."""
    out: set[str] = set()
    todo = [("", value)]
    while todo:
        at, v = todo.pop()
        if at:
            out.add(f"{at} object" if isinstance(v, dict) else f"{at} list" if isinstance(v, list) else f"{at} value")
        if isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{at}[]", x) for x in v]
    return out


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode(errors="surrogatepass")).hexdigest()[:16]


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """fingerprint -> mapping; the first mapping that claims a set of paths has it. A list may be empty."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for paths in m.path_sets():
            out.setdefault(fingerprint(paths), m)
            if m.each:
                out.setdefault(fingerprint({p for p in paths if "[]" not in p}), m)
    return out


# --- template -----------------------------------------------------------------------------------------------------

#: Control strings that texts must not smuggle in.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RAW = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(s: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], s)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """(segment, start of loss, length of loss). In a role, a space is doubled and a new line is a space and n."""
    name, body = escape(role).replace(" ", "  ").replace("\n", " n"), escape(text)
    head = f"{OPEN}{name}\n"
    return head + body + CLOSE, *((len(head), len(body)) if role == "assistant" else (None, None))


def read_segment(segment: str) -> tuple[str, str]:
    name, _, body = segment[len(OPEN) : -len(CLOSE)].partition("\n")
    name = re.sub(" (.)", lambda m: "\n" if m[1] == "n" else " ", name, flags=re.S)
    return unescape(name), unescape(body)


def read_document(text: str) -> list[tuple[str, str]]:
    """The turns of a whole formatted conversation: segments end where the only unescaped end marks are."""
    return [read_segment(s + CLOSE) for s in text.split(CLOSE)[:-1]]


# --- operators ----------------------------------------------------------------------------------------------------


def format_records(records: DataFrame, key: str = "conv_id", order: str = "turn", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, order, piece, layout, fingerprint, segment, loss_start, loss_chars): one row per turn of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(mappings)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["key", "order", "piece", "layout", "fingerprint", "segment", "loss_start", "loss_chars"]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for k, o, r in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    value = json.loads(r) if r is not None else None
                except (ValueError, RecursionError):
                    value = None
                mark = fingerprint(field_paths(value)) if isinstance(value, dict) else None
                mapping = known.get(mark)
                if mapping is None:
                    out.append((k, o, 0, None, mark, None, None, None))
                    continue
                for i, (role, text) in enumerate(mapping.apply(value)):
                    out.append((k, o, i, mapping.name, mark, *render(role, text)))
                    held += len(text)
                if held > 1 << 22:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = records.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("order"), F.col(record).alias("record"))
    return rows.mapInArrow(run, "key long, order long, piece int, layout string, fingerprint string, segment string, loss_start long, loss_chars long")


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the segments alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        at, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for k, seg, start, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if state is None or k != at:
                    close()
                    at, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(seg)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(seg[start : start + n])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(seg)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        close()
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    rows = formatted.filter(F.col("segment").isNotNull())
    rows = rows.repartition("key").sortWithinPartitions("key", "order", "piece", "segment").select("key", "segment", "loss_start", "loss_chars")
    return rows.mapInArrow(run, "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_records(turns: DataFrame, chunk: int = 8, most: int = 64) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as records (conv_id, turn, record) of five layouts, by a hash of the
    conversation. In the layout of whole lists, the rows of `chunk` turns in a row are the messages of one record, where
    these are no more than `most` rows (turns may repeat); in the others each row is a record."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.floor(F.col("turn") / chunk).alias("chunk"))
    known = F.col("role").isin("user", "assistant", "system")
    draw = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    size = turns.filter(draw == 4).groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    size = size.select(F.col("conv_id").alias("c_id"), F.col("chunk").alias("c_chunk"))
    fits = turns["conv_id"].eqNullSafe(F.col("c_id")) & turns["chunk"].eqNullSafe(F.col("c_chunk"))
    listed = turns.filter(draw == 4).join(size, fits, "left_semi")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    listed = listed.groupBy("conv_id", "chunk").agg(F.min("turn").alias("turn"), F.sort_array(F.collect_list(message)).alias("m"))
    listed = listed.select("conv_id", "turn", F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("record"))
    single = turns.filter(draw != 4).unionByName(turns.filter(draw == 4).join(size, fits, "left_anti"))
    kind = F.when(known, F.pmod(F.xxhash64("conv_id"), F.lit(5))).otherwise(0)
    is_a = lambda name: F.col("role") == name
    other = F.when(is_a("user"), F.lit("human")).when(is_a("assistant"), F.lit("gpt")).otherwise(F.col("role"))
    one = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    said = F.col("text")
    record = (
        F.when(kind == 1, one(conversations=F.array(F.struct(other.alias("from"), said.alias("value")))))
        .when((kind == 2) & is_a("user"), one(prompt=said))
        .when((kind == 2) & is_a("assistant"), one(completion=said))
        .when((kind == 3) & is_a("user"), one(instruction=said))
        .when((kind == 3) & is_a("assistant"), one(output=said))
        .when(kind.isin(2, 3) & is_a("system"), one(system=said))
        .otherwise(one(messages=F.array(F.struct(F.col("role").alias("role"), said.alias("content")))))
    )
    return single.select("conv_id", "turn", record.alias("record")).unionByName(listed)
