"""Dense networks as ONNX files, written without the onnx package.

An ONNX file is one protocol-buffer message. The field numbers below are those of its public
definition; only what a chain of dense layers needs is here."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

# Field numbers of the messages, and the numbers of the types used.
MODEL = {"ir_version": 1, "producer": 2, "graph": 7, "opset": 8}
GRAPH = {"node": 1, "name": 2, "initializer": 5, "input": 11, "output": 12}
NODE = {"input": 1, "output": 2, "name": 3, "op": 4}
TENSOR = {"dims": 1, "type": 2, "name": 8, "raw": 9}
TYPES, IR_VERSION, OPSET = {"float": 1, "double": 11}, 8, 13


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes | str) -> bytes:
    value = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _tensor(name: str, a: np.ndarray, kind: str) -> bytes:
    raw = struct.pack(f"<{a.size}{kind[0]}", *a.astype(np.float64).ravel().tolist())
    return b"".join([*[_number(TENSOR["dims"], d) for d in a.shape], _number(TENSOR["type"], TYPES[kind]), _bytes(TENSOR["name"], name), _bytes(TENSOR["raw"], raw)])


def _value(name: str, width: int, kind: str) -> bytes:
    """A matrix of any number of rows."""
    shape = b"".join(_bytes(1, d) for d in (_bytes(2, "rows"), _number(1, width)))
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, TYPES[kind]) + _bytes(2, shape)))


def _node(op: str, name: str, inputs: Sequence[str], output: str) -> bytes:
    return b"".join([*[_bytes(NODE["input"], x) for x in inputs], _bytes(NODE["output"], output), _bytes(NODE["name"], name), _bytes(NODE["op"], op)])


def dense(layers: Sequence[tuple[np.ndarray, np.ndarray]], activation: str = "Relu", input_name: str = "features", output_name: str = "logit", kind: str = "float") -> bytes:
    """A network of dense layers (weights in x out, bias), `activation` between them, none after the last,
    in single (float) or double precision."""
    nodes, weights, at = [], [], input_name
    for i, (w, b) in enumerate(layers):
        last = i == len(layers) - 1
        out = output_name if last else f"sum_{i}"
        weights += [_tensor(f"w_{i}", np.asarray(w), kind), _tensor(f"b_{i}", np.asarray(b), kind)]
        nodes.append(_node("Gemm", f"dense_{i}", [at, f"w_{i}", f"b_{i}"], out))
        if not last:
            nodes.append(_node(activation, f"act_{i}", [out], f"hidden_{i}"))
            at = f"hidden_{i}"
    graph = b"".join([*[_bytes(GRAPH["node"], n) for n in nodes], _bytes(GRAPH["name"], "dense"), *[_bytes(GRAPH["initializer"], w) for w in weights], _bytes(GRAPH["input"], _value(input_name, np.asarray(layers[0][0]).shape[0], kind)), _bytes(GRAPH["output"], _value(output_name, np.asarray(layers[-1][0]).shape[1], kind))])
    return b"".join([_number(MODEL["ir_version"], IR_VERSION), _bytes(MODEL["producer"], "emberline"), _bytes(MODEL["graph"], graph), _bytes(MODEL["opset"], _bytes(1, "") + _number(2, OPSET))])


def from_logistic(model) -> bytes:
    """A fitted binary logistic regression of Spark ML as a network of one layer."""
    return dense([(np.array(model.coefficients.toArray())[:, None], np.array([model.intercept]))])


def from_perceptron(model, kind: str = "float") -> bytes:
    """A fitted two-class perceptron of Spark ML as a network; its logit is the difference of the
    two classes' last sums, as the softmax of two is the sigmoid of their difference."""
    sizes, flat, layers = list(model.getLayers()), np.array(model.weights.toArray()), []
    at = 0
    for m, n in zip(sizes, sizes[1:]):
        layers.append((flat[at : at + m * n].reshape(n, m, order="F").T, flat[at + m * n : at + m * n + n]))
        at += m * n + n
    w, b = layers[-1]
    layers[-1] = (w[:, 1:] - w[:, :1], b[1:] - b[:1])
    return dense(layers, "Sigmoid", kind=kind)
