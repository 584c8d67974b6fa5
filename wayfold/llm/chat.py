"""Chat formatting: conversations merged into prefix trees, shared turns emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's marks, and strings that other templates use; none survives unescaped in a text.
BEGIN, END = "<|turn|>", "<|end|>\n"
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A tree goes on in a new pack, with its open path emitted again, beyond so many tokens or conversations.
PACK_TOKENS, PACK_CONVERSATIONS = 65_536, 4_096
#: Turns that range splitters hold, so that splitters are of bounded size.
HEAD = 16

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

PACK = (
    "pack string, text string, nodes array<struct<parent:int,start:int,length:int,position:int,loss_start:int,loss_length:int,attends:array<struct<start:int,stop:int>>>>, "
    "conversations array<struct<conv_id:bigint,node:int>>"
)


def escape(text: str) -> str:
    """Double backslashes, and put one into every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{BEGIN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{END}"


def parse_turns(text: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def loss_span(turn: str) -> tuple[int, int]:
    """Where in a formatted turn the text that is learned from starts, and its length; 0 unless the role is assistant."""
    head = turn.index("\n", len(BEGIN)) + 1
    while turn[head - 2] == "\\":  # an escaped newline of the role
        head = turn.index("\n", head) + 1
    return (head, len(turn) - len(END) - head) if turn[len(BEGIN) : head - 1] == "assistant" else (head, 0)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, role, text) -> one row a conversation: its path of chained hashes and formatted turns."""
    cur, path, turns, key = None, [], [], b""
    out: list[tuple] = []

    def full() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.string()))], ["conv_id", "path", "turns"])

    size = 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and conv != cur:
                out.append((cur, path, turns))
                path, turns, key = [], [], b""
                if size > 4 << 20:
                    yield full()
                    size = 0
            cur, turn = conv, format_turn(role or "", text or "")
            key = hashlib.blake2b(key + turn.encode(), digest_size=16).digest()
            path.append(int.from_bytes(key[:8], "big", signed=True))
            turns.append(turn)
            size += len(turn)
    if turns:
        out.append((cur, path, turns))
    if out:
        yield full()


class _Pack:
    """A part of the forest that is being emitted depth first."""

    def __init__(self):
        self.text, self.nodes, self.size, self.convs = [], [], 0, []
        self.open: list[tuple[int, int, str]] = []  # (hash, node, turn) of the path to the last node

    def shared(self, path: list[int], turns: list[str]) -> int:
        n = 0
        for (h, _, t), p, u in zip(self.open, path, turns, strict=False):
            if h != p or t != u:
                break
            n += 1
        return n

    def add(self, conv, path: list[int], turns: list[str]) -> None:
        n = self.shared(path, turns)
        del self.open[n:]
        for h, turn in zip(path[n:], turns[n:], strict=True):
            up = self.nodes[self.open[-1][1]] if self.open else None
            attends = [list(x) for x in up["attends"]] if up else []
            if up:
                if attends and attends[-1][1] == up["start"]:
                    attends[-1][1] = up["start"] + up["length"]
                else:
                    attends.append([up["start"], up["start"] + up["length"]])
            at, length = loss_span(turn)
            self.nodes.append(
                {"parent": self.open[-1][1] if up else -1, "start": self.size, "length": len(turn), "position": up["position"] + up["length"] if up else 0,
                 "loss_start": self.size + at, "loss_length": length, "attends": attends}
            )
            self.open.append((h, len(self.nodes) - 1, turn))
            self.text.append(turn)
            self.size += len(turn)
        self.convs.append({"conv_id": conv, "node": self.open[-1][1] if self.open else -1})

    def row(self) -> dict:
        text = "".join(self.text)
        nodes = [n | {"attends": [{"start": a, "stop": b} for a, b in n["attends"]]} for n in self.nodes]
        first = self.convs[0]["conv_id"]
        return {"pack": hashlib.sha256(f"{first}\n{text}".encode()).hexdigest()[:32], "text": text, "nodes": nodes, "conversations": self.convs}


_PACK_TYPE = pa.schema(
    [
        ("pack", pa.string()),
        ("text", pa.string()),
        ("nodes", pa.list_(pa.struct([*[(c, pa.int32()) for c in ("parent", "start", "length", "position", "loss_start", "loss_length")], ("attends", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))),
        ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
    ]
)


def _packs(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    pack, root = _Pack(), None
    for batch in batches:
        for conv, path, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "turns")), strict=True):
            new = sum(map(len, turns[pack.shared(path, turns) :]))
            if pack.convs and (path[0] != root or pack.size + new > tokens or len(pack.convs) >= PACK_CONVERSATIONS):
                yield pa.RecordBatch.from_pylist([pack.row()], _PACK_TYPE)
                pack = _Pack()
            root = path[0]
            pack.add(conv, path, turns)
    if pack.convs:
        yield pa.RecordBatch.from_pylist([pack.row()], _PACK_TYPE)


def pack_chats(turns: DataFrame, tokens: int = PACK_TOKENS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Return packs (PACK): formatted text whose tokens are code points, its nodes and its conversations.

    A node is a turn that all conversations below it share, emitted once and after its parent. It
    takes text[start : start + length], its tokens have position ids from ``position`` on, as in
    each single conversation, and they attend to themselves causally and to the intervals in
    ``attends``, its ancestors, merged where they touch. Loss is taken on
    text[loss_start : loss_start + loss_length]. A conversation names its last node.

    Turns meet by conversation and are hashed in chains; conversations are then range-partitioned
    by their first turns' hashes and their id, so that neither a common first turn nor a common
    conversation falls to one task, and sorted by path, which is depth-first order. A pack holds
    one tree or, beyond ``tokens``, part of one, and repeats the open path of turns at its start.

    Null roles and texts count as empty; turns of one number are taken in order of role and text; a
    null conv_id is a conversation of its own; other columns are ignored; an empty table gives none.
    """
    slim = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    by_conv = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    convs = by_conv.mapInArrow(_conversations, "conv_id long, path array<long>, turns array<string>").withColumn("head", F.slice("path", 1, HEAD))
    ordered = convs.repartitionByRange("head", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(lambda it: _packs(it, tokens), PACK)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, nodes, convs in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "conversations")), strict=True):
            seen = {}
            for c in convs:
                if c["node"] not in seen:
                    n = nodes[c["node"]]
                    spans = [(a["start"], a["stop"]) for a in n["attends"]] + [(n["start"], n["start"] + n["length"])]
                    whole = "".join(text[a:b] for a, b in spans)
                    pairs = parse_turns(whole)
                    inside = [m for m in nodes if m["loss_length"] and any(a <= m["start"] < b for a, b in spans)]
                    loss = "".join(unescape(text[m["loss_start"] : m["loss_start"] + m["loss_length"]]) for m in inside)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
                    seen[c["node"]] = (len(pairs), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
                out.append((c["conv_id"], *seen[c["node"]]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of every conversation, from the text, nodes and intervals of the packs alone."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return packs.select("text", "nodes", "conversations").mapInArrow(_read_back, kinds)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, packed and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return read_back(pack_chats(turns.unionByName(odd)))


def _sql() -> str:
    esc = lambda c, newline: "".join(["replace("] * (len(CONTROL) + 1 + newline)) + c + ", '\\', '\\\\')" + "".join(f", '{x}', '{x[0]}\\{x[1:]}')" for x in CONTROL) + (", chr(10), '\\' || chr(10))" if newline else "")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({esc('role', True)}) + length({esc('text', False)}) + {len(BEGIN) + 1 + len(END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


OP7_SQL = _sql()
