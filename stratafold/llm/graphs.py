"""The attention of ``lm`` as graphs of ``onnxruntime``, which fuses the passes over class logits and multiplies small matrices without a call for each.

The arithmetic is that of ``lm.forward`` and ``lm.gradients`` in 32-bit numbers, on one thread (scores of attention are not cut at 60, as shares are taken from their greatest). Where ``onnxruntime`` is missing, importing this module fails and ``lm`` does it in numpy.
Graphs are written as the bytes of ONNX's protocol buffers, as its own builder is another package.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import onnxruntime

FUSED = "com.microsoft"
KINDS = {np.dtype(np.float32): 1, np.dtype(np.int32): 6, np.dtype(np.int64): 7}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _bytes(field: int, x: bytes | str) -> bytes:
    x = x.encode() if isinstance(x, str) else x
    return _varint(field << 3 | 2) + _varint(len(x)) + x


def _constant(name: str, x: np.ndarray) -> bytes:
    return b"".join(_number(1, d) for d in x.shape) + _number(2, KINDS[x.dtype]) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(x).tobytes())


def _attribute(name: str, x: float | int | str) -> bytes:
    if isinstance(x, float):
        return _bytes(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", x) + _number(20, 1)
    return _bytes(1, name) + (_bytes(4, x) + _number(20, 3) if isinstance(x, str) else _number(3, x) + _number(20, 2))


def _value(name: str, kind: type, shape: tuple) -> bytes:
    dims = b"".join(_bytes(1, _bytes(2, d) if isinstance(d, str) else _number(1, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, KINDS[np.dtype(kind)]) + _bytes(2, dims)))


class Graph:
    """Nodes, inputs, outputs and constants; ``do`` adds a node and gives the name of its result."""

    def __init__(self):
        self.nodes, self.inputs, self.constants, self.n = [], [], [], 0

    def input(self, name: str, kind: type, *shape: int | str) -> str:
        self.inputs.append(_value(name, kind, shape))
        return name

    def constant(self, x: np.ndarray) -> str:
        self.n += 1
        self.constants.append(_constant(f"c{self.n}", x))
        return f"c{self.n}"

    def do(self, op: str, *of: str, **how: float | int | str) -> str:
        self.n += 1
        domain = _bytes(7, FUSED) if op == "FusedMatMul" else b""
        self.nodes.append(b"".join(_bytes(1, x) for x in of) + _bytes(2, f"t{self.n}") + _bytes(4, op) + b"".join(_bytes(5, _attribute(*x)) for x in how.items()) + domain)
        return f"t{self.n}"

    def session(self, **outputs: tuple) -> onnxruntime.InferenceSession:
        """One thread; ``outputs``: results and their shapes."""
        made = b"".join(_bytes(1, x) for x in self.nodes) + _bytes(2, "lm") + b"".join(_bytes(5, x) for x in self.constants)
        made += b"".join(_bytes(11, x) for x in self.inputs) + b"".join(_bytes(12, _value(name, np.float32, shape)) for name, shape in outputs.items())
        domains = b"".join(_bytes(8, _bytes(1, d) + _number(2, version)) for d, version in (("", 17), (FUSED, 1)))
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        return onnxruntime.InferenceSession(_number(1, 8) + _bytes(7, made) + domains, options, providers=["CPUExecutionProvider"])


def _forward(g: Graph, q_of: str, k_of: str, v_of: str, shut: str, w: str, table: str, span: int, dim: int) -> dict[str, str]:
    """Queries, keys, values, shares of attention (blocks, queries, keys), output and class logits; inputs are rows of last ids, of keys, and which blocks are alone."""
    now, keys, alone = g.input("now", np.int32, "n", span), g.input("keys", np.int32, "n", 2 * span), g.input("alone", np.int32, "n")
    q, k, v = g.do("Gather", q_of, now), g.do("Gather", k_of, keys), g.do("Gather", v_of, keys)
    s = g.do("FusedMatMul", q, k, transB=1, alpha=1 / math.sqrt(dim))
    a = g.do("Softmax", g.do("Add", s, g.do("Gather", shut, alone)), axis=-1)
    o = g.do("Reshape", g.do("MatMul", a, v), g.constant(np.array([-1, dim])))
    logits = g.do("Gemm", o, w, g.do("Gather", table, g.do("Reshape", now, g.constant(np.array([-1])))))
    return {"q": q, "k": k, "v": v, "a": a, "o": o, "logits": logits}


def _feeds(now: np.ndarray, before: np.ndarray, alone: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Inputs of ``_forward`` from ``len(before)`` runs of blocks, and the rows of each run and of the block before it."""
    rows = np.concatenate([before[:, None], now.reshape(len(before), -1, now.shape[1])], 1).astype(np.int32)
    keys = np.concatenate([rows[:, :-1], rows[:, 1:]], 2).reshape(len(now), -1)
    return {"now": rows[:, 1:].reshape(now.shape), "keys": keys, "alone": alone.astype(np.int32)}, rows


def _shut(bias: np.ndarray, rel: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """What is added to the scores of a block (queries by keys), and of one that does not see the block before it."""
    seen = np.where(open_, bias[rel], -1e9).T
    alone = seen.copy()
    alone[:, : len(seen)] = -1e9
    return np.stack([seen, alone]).astype(np.float32)


class Scores:
    """The log probability of the class of each next id of a batch."""

    def __init__(self, params: list[np.ndarray], table: np.ndarray, rel: np.ndarray, open_: np.ndarray):
        g, (q_of, k_of, v_of, bias, w) = Graph(), params
        f = _forward(g, *map(g.constant, (q_of, k_of, v_of, _shut(bias, rel, open_), w, table)), rel.shape[1], w.shape[0])
        own = g.do("GatherElements", g.do("LogSoftmax", f["logits"], axis=-1), g.input("classes", np.int32, "ids", 1), axis=1)
        self.session = g.session(**{own: ("ids", 1)})

    def __call__(self, now: np.ndarray, before: np.ndarray, alone: np.ndarray, classes: np.ndarray) -> np.ndarray:
        feeds, _ = _feeds(now, before, alone)
        return self.session.run(None, feeds | {"classes": classes.astype(np.int32).reshape(-1, 1)})[0].ravel()


class Gradients:
    """Gradients of the mean loss, as ``lm.gradients`` gives them, but those of queries, keys and values not yet summed up by row: behind the rows they belong to."""

    def __init__(self, params: list[np.ndarray], table: np.ndarray, rel: np.ndarray, open_: np.ndarray):
        g, span, (dim, classes) = Graph(), rel.shape[1], params[4].shape
        self.rel, self.open, scale = rel, open_, 1 / math.sqrt(dim)
        given = [g.input(name, np.float32, *p.shape) for name, p in zip(("q_of", "k_of", "v_of"), params[:3], strict=True)]
        shut, w, weight, cls = g.input("shut", np.float32, 2, span, 2 * span), g.input("w", np.float32, dim, classes), g.input("weight", np.float32, "ids", dim), g.input("classes", np.int32, "ids", 1)
        f = _forward(g, *given, shut, w, g.constant(table), span, dim)
        less = g.input("less", np.float32, "ids", 1)
        d = g.do("ScatterElements", g.do("Softmax", f["logits"], axis=-1), cls, less, axis=1, reduction="add")
        dw = g.do("Gemm", g.do("Mul", f["o"], weight), d, transA=1)
        do = g.do("Mul", g.do("Gemm", d, w, transB=1), weight)
        own = g.do("ReduceSum", g.do("Mul", do, f["o"]), g.constant(np.array([-1])), keepdims=1)
        blocks = g.constant(np.array([-1, span, dim]))
        do, own = g.do("Reshape", do, blocks), g.do("Reshape", own, g.constant(np.array([-1, span, 1])))
        ds = g.do("Mul", f["a"], g.do("Sub", g.do("FusedMatMul", do, f["v"], transB=1), own))
        dq = g.do("FusedMatMul", ds, f["k"], alpha=scale)
        dk = g.do("FusedMatMul", ds, f["q"], transA=1, alpha=scale)
        dv = g.do("FusedMatMul", f["a"], do, transA=1)
        dbias = g.do("ReduceSum", ds, g.constant(np.array([0])), keepdims=0)
        self.session = g.session(**{dq: ("n", span, dim), dk: ("n", 2 * span, dim), dv: ("n", 2 * span, dim), dbias: (span, 2 * span), dw: (dim, classes)})

    def __call__(self, params: list[np.ndarray], now: np.ndarray, before: np.ndarray, alone: np.ndarray, classes: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
        feeds, rows = _feeds(now, before, alone)
        weight = np.empty((real.size, len(params[4])), np.float32)  # of full width: short rows are slow to spread
        np.divide(real.reshape(-1, 1), max(1.0, float(np.count_nonzero(real))), weight, casting="unsafe")
        feeds |= dict(zip(("q_of", "k_of", "v_of"), params[:3], strict=True)) | {"w": params[4], "shut": _shut(params[3], self.rel, self.open), "weight": weight}
        feeds |= {"classes": classes.astype(np.int32).reshape(-1, 1), "less": np.full((real.size, 1), -1, np.float32)}
        dq, *pairs, dbias, dw = self.session.run(None, feeds)
        runs, more, span = rows.shape
        summed = []
        for pair in pairs:  # a block's keys are seen by its own queries and by those of the next block
            pair = pair.reshape(runs, more - 1, 2, -1)
            both = np.empty((runs, more, pair.shape[-1]), np.float32)
            both[:, 0], both[:, -1] = pair[:, 0, 0], pair[:, -1, 1]
            np.add(pair[:, 1:, 0], pair[:, :-1, 1], both[:, 1:-1])
            summed.append(both)
        dbias = np.bincount(self.rel.ravel(), (dbias.T * self.open).ravel(), len(params[3])).astype(np.float32)
        return [rows, dq, *summed, dbias, dw]
