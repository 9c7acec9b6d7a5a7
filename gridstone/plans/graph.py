"""A serialisable operator graph: named values, nodes, stored parameters; lowered to one lazy Spark plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridstone import ops
from gridstone.frame import LatticeFrame
from gridstone.functions.quantized import QuantizedWeight

SCHEMA = "1"
COORDINATE_ORDER = ("batch", "x", "y", "z")
FEATURE_LAYOUT = ("row", "channel")

#: Kinds of values that pass between nodes.
KINDS = (
    "any", "sparse_tensor", "dense_tensor", "relation", "coordinate_set", "alignment", "quantization",
    "point_voxel_map", "coordinate_ordering", "sparse_occupancy", "occupancy_expansion", "bytes",
)


def kind_of(value: Any) -> str:
    """The kind of a value, as far as its type tells it."""
    if isinstance(value, LatticeFrame):
        return "sparse_tensor"
    if isinstance(value, ops.Relation):
        return "relation"
    if isinstance(value, ops.SparseQuantization):
        return "quantization"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, DataFrame):
        names = set(value.columns)
        for kind, columns in (
            ("alignment", {"lhs_row", "rhs_row"}),
            ("point_voxel_map", {"point_id", "corner", "voxel_row", "weight"}),
            ("occupancy_expansion", {"parent_row", "child", "x"}),
            ("sparse_occupancy", {"occupancy"}),
            ("coordinate_ordering", {"position"}),
            ("relation", {"query_row", "source_row"}),
        ):
            if columns <= names:
                return kind
        return "coordinate_set" if {"x", "y", "z"} <= names else "dense_tensor"
    return "dense_tensor" if isinstance(value, np.ndarray) else "any"


@dataclass(frozen=True)
class Operation:
    """A function and which of its arguments are parameters of the artifact."""

    name: str
    function: Callable[..., Any]
    parameters: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)


_PARAMETERS = {
    **dict.fromkeys(("conv3d", "subm_conv3d", "conv_transpose3d", "generative_conv_transpose3d", "linear", "quantized_matmul"), ("weight", "q", "bias")),
    "batch_norm": ("mean", "var", "weight", "bias"),
    "layer_norm": ("weight", "bias"),
    "rms_norm": ("weight",),
}


def field_of(value: Any, field: str) -> Any:
    """A part of a structured value, or a column of a table."""
    if isinstance(value, DataFrame):
        return value.select(*[c for c in ("row_id", "point_id") if c in value.columns and c != field], field)
    if field.startswith("_") or not hasattr(value, field):
        raise ValueError(f"no field {field!r}")
    return getattr(value, field)


def _registry() -> dict[str, Operation]:
    out = {f"ops.{n}": Operation(f"ops.{n}", f, _PARAMETERS.get(n, ())) for n, f in ops.OPERATORS.items()}
    first = {"input": "x"}

    def alias(name: str, of: str, rename: dict[str, str]) -> None:
        out[name] = Operation(name, ops.OPERATORS[of], _PARAMETERS.get(of, ()), rename)

    for n in ("conv3d", "subm_conv3d", "conv_transpose3d", "generative_conv_transpose3d"):
        alias(f"sparse.{n}", n, first)
        alias(f"sparse.quantized_{n}", n, first)
    alias("sparse.add", "sparse_add", {})
    alias("feature.linear", "linear", first)
    alias("feature.quantized_linear", "linear", first)
    for n in ("relu", "sigmoid", "silu", "tanh", "gelu", "leaky_relu", "softplus", "dropout", "batch_norm", "layer_norm", "rms_norm"):
        alias(f"feature.{n}", n, first)
    for n in ("sum", "avg", "max"):
        alias(f"pool.global_{n}", f"global_{n}_pool", first)
    out["value.field"] = Operation("value.field", field_of, (), {"input": "value"})
    return out


REGISTRY = _registry()


def operation_spec(name: str) -> Operation:
    if name not in REGISTRY:
        raise KeyError(f"unknown operation {name!r}")
    return REGISTRY[name]


def iter_operation_specs() -> list[Operation]:
    """All operations by name."""
    return [REGISTRY[n] for n in sorted(REGISTRY)]


def register(name: str, parameters: tuple[str, ...] = ()) -> Callable:
    """Decorator that adds an operation of one's own to the registry."""

    def add(function: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name!r} is registered already")
        REGISTRY[name] = Operation(name, function, parameters)
        return function

    return add


@dataclass
class Node:
    """id, operation, inputs (argument to value name or list of names), output name, parameters (argument to stored name), attributes."""

    id: str
    op: str
    inputs: dict[str, str | list[str]]
    output: str
    parameters: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, Any] = field(default_factory=dict)


@dataclass
class Manifest:
    """The logical plan: typed inputs, nodes in order, typed outputs."""

    inputs: dict[str, str]
    outputs: dict[str, str]
    nodes: list[Node]
    dtype_policy: str = "preserve"
    schema_version: str = SCHEMA
    coordinate_order: tuple[str, ...] = COORDINATE_ORDER
    feature_layout: tuple[str, ...] = FEATURE_LAYOUT

    def check(self, parameters: set[str] | None = None) -> Manifest:
        """Raise for what cannot run: unknown operations, names used before they are made or made twice, missing parameters."""
        if self.schema_version != SCHEMA:
            raise ValueError(f"schema version {self.schema_version!r} is not {SCHEMA!r}")
        if tuple(self.coordinate_order) != COORDINATE_ORDER or tuple(self.feature_layout) != FEATURE_LAYOUT:
            raise ValueError("another coordinate order or feature layout")
        if self.dtype_policy not in ("preserve", "float", "double"):
            raise ValueError(f"unknown dtype policy {self.dtype_policy!r}")
        for kind in (*self.inputs.values(), *self.outputs.values()):
            if kind not in KINDS:
                raise ValueError(f"unknown kind {kind!r}")
        known, ids = set(self.inputs), set()
        for node in self.nodes:
            spec = operation_spec(node.op)
            if node.id in ids or node.output in known:
                raise ValueError(f"{node.id}: the id or output {node.output!r} is taken")
            for value in node.inputs.values():
                for name in [value] if isinstance(value, str) else value:
                    if name not in known:
                        raise ValueError(f"{node.id}: {name!r} is not known here")
            for argument, name in node.parameters.items():
                if argument not in spec.parameters:
                    raise ValueError(f"{node.id}: {argument!r} is no parameter of {node.op}")
                if parameters is not None and name not in parameters:
                    raise ValueError(f"{node.id}: parameter {name!r} is not stored")
            ids.add(node.id)
            known.add(node.output)
        for name in self.outputs:
            if name not in known:
                raise ValueError(f"output {name!r} is never made")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        data = json.loads(text)
        data["nodes"] = [Node(**n) for n in data["nodes"]]
        for key in ("coordinate_order", "feature_layout"):
            data[key] = tuple(data[key])
        return cls(**data).check()


class GraphBuilder:
    """Collects nodes and parameters; values are names."""

    def __init__(self, dtype_policy: str = "preserve") -> None:
        self._manifest = Manifest({}, {}, [], dtype_policy)
        self.parameters: dict[str, Any] = {}

    def input(self, name: str, kind: str = "sparse_tensor") -> str:
        self._manifest.inputs[name] = kind
        return name

    def add_parameter(self, name: str, value: Any) -> str:
        if name in self.parameters:
            raise ValueError(f"{name!r} is stored already")
        self.parameters[name] = value if isinstance(value, QuantizedWeight) else np.asarray(value)
        return name

    add_quantized_parameter = add_parameter

    def add_op(self, op: str, inputs: dict[str, str | list[str]], parameters: dict[str, str] | None = None, output: str | None = None, **attributes: Any) -> str:
        operation_spec(op)
        number = len(self._manifest.nodes)
        node = Node(f"n{number}", op, inputs, output or f"v{number}", parameters or {}, attributes)
        self._manifest.nodes.append(node)
        return node.output

    def call(self, name: str, x: str, parameters: dict[str, str] | None = None, **attributes: Any) -> str:
        """An operator of one frame by its plain name."""
        return self.add_op(f"ops.{name}", {"x": x}, parameters, **attributes)

    def add_module(self, module: Any, x: str) -> str:
        return module.build(self, x)

    def field(self, value: str, field: str) -> str:
        return self.add_op("value.field", {"value": value}, field=field)

    def output(self, name: str, kind: str = "any") -> None:
        self._manifest.outputs[name] = kind

    def manifest(self) -> Manifest:
        return self._manifest.check(set(self.parameters))


class LatticeModel:
    """Runs a checked manifest. Nodes only build DataFrames, so Catalyst optimises across all of them at once."""

    def __init__(self, manifest: Manifest, parameters: dict[str, Any]) -> None:
        self.manifest = manifest.check(set(parameters))
        self.parameters = parameters

    def __call__(self, **inputs: Any) -> dict[str, Any]:
        m = self.manifest
        if set(inputs) != set(m.inputs):
            raise ValueError(f"inputs {sorted(m.inputs)} are needed, not {sorted(inputs)}")
        values: dict[str, Any] = {}
        for name, value in inputs.items():
            self._fits(name, m.inputs[name], value)
            values[name] = self._typed(value)
        for node in m.nodes:
            spec = operation_spec(node.op)
            args = {spec.rename.get(k, k): values[v] if isinstance(v, str) else [values[n] for n in v] for k, v in node.inputs.items()}
            args |= {k: self.parameters[v] for k, v in node.parameters.items()}
            values[node.output] = self._typed(spec.function(**args, **node.attributes))
        for name, kind in m.outputs.items():
            self._fits(name, kind, values[name])
        return {name: values[name] for name in m.outputs}

    @staticmethod
    def _fits(name: str, kind: str, value: Any) -> None:
        if kind != "any" and kind_of(value) != kind:
            raise ValueError(f"{name!r} is {kind_of(value)}, not {kind}")

    def _typed(self, value: Any) -> Any:
        policy = self.manifest.dtype_policy
        return value.astype(policy) if policy != "preserve" and isinstance(value, LatticeFrame) else value


_WEIGHTS = "name string, part string, kind string, shape array<int>, data binary, note string"


def _stored(name: str, value: Any) -> list[tuple]:
    row = lambda part, a, note="": (name, part, str(a.dtype), list(a.shape), bytearray(np.ascontiguousarray(a).tobytes()), note)
    if isinstance(value, QuantizedWeight):
        note = json.dumps({"group_size": value.group_size, "bits": value.bits, "shape": value.shape, "layout": value.layout})
        return [row("words", value.words, note), row("scales", value.scales, note), row("biases", value.biases, note)]
    return [row("array", np.asarray(value))]


def save_model(spark: SparkSession, path: str, model: LatticeModel) -> None:
    """``path``/manifest as text, ``path``/weights as Parquet; both through Spark, so any store will do."""
    rows = [r for name, value in sorted(model.parameters.items()) for r in _stored(name, value)]
    spark.createDataFrame(rows, _WEIGHTS).coalesce(1).write.parquet(f"{path}/weights")
    spark.createDataFrame([(model.manifest.to_json(),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> LatticeModel:
    manifest = Manifest.from_json("".join(r[0] for r in spark.read.text(f"{path}/manifest", wholetext=True).collect()))
    parts: dict[str, dict[str, Any]] = {}
    notes: dict[str, str] = {}
    for r in spark.read.parquet(f"{path}/weights").collect():
        parts.setdefault(r["name"], {})[r["part"]] = np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"])
        notes[r["name"]] = r["note"]
    parameters: dict[str, Any] = {}
    for name, arrays in parts.items():
        if "words" in arrays:
            note = json.loads(notes[name])
            note["shape"] = tuple(note["shape"])
            parameters[name] = QuantizedWeight(**arrays, **note)
        else:
            parameters[name] = arrays["array"]
    return LatticeModel(manifest, parameters)


save_lattice_artifact = save_lattice_model = save_model
load_lattice_artifact = load_lattice_model = load_model


def build_graph_artifact(build: Callable[[GraphBuilder], None], dtype_policy: str = "preserve") -> LatticeModel:
    builder = GraphBuilder(dtype_policy)
    build(builder)
    return LatticeModel(builder.manifest(), builder.parameters)


def save_lattice_graph(spark: SparkSession, path: str, build: Callable[[GraphBuilder], None], dtype_policy: str = "preserve") -> None:
    save_model(spark, path, build_graph_artifact(build, dtype_policy))


def save_lattice_module(spark: SparkSession, path: str, module: Any) -> None:
    save_model(spark, path, build_module_artifact(module))


def build_module_artifact(module: Any) -> LatticeModel:
    """A module as a model with input ``x`` and output ``y``."""

    def build(g: GraphBuilder) -> None:
        x = g.input("x")
        out = module.build(g, x)
        g.output(out)

    return build_graph_artifact(build)
