"""Parameter-owning modules over the operators; each can run and can add itself to a graph."""

from __future__ import annotations

import math
from typing import Any

import numpy as np

from gridstone import ops
from gridstone.frame import LatticeFrame
from gridstone.functions.quantized import quantize_weight
from gridstone.geometry import KernelSpec
from gridstone.operators.features import batch_statistics


class Module:
    """An operator name, parameters (arrays or packed weights) and attributes."""

    op = ""

    def __init__(self, **attributes: Any) -> None:
        self.attributes = attributes
        self.parameters: dict[str, Any] = {}

    def __call__(self, x: LatticeFrame) -> Any:
        return ops.OPERATORS[self.op](x, **{k: v for k, v in self.parameters.items() if v is not None}, **self.attributes)

    def build(self, graph: Any, x: str) -> str:
        number = len(graph.parameters)
        named = {k: graph.add_parameter(f"p{number}.{k}", v) for k, v in self.parameters.items() if v is not None}
        return graph.call(self.op, x, named, **self.attributes)


def _uniform(shape: tuple[int, ...], fan_in: int, seed: int) -> np.ndarray:
    bound = math.sqrt(1 / fan_in)
    return np.random.default_rng(seed).uniform(-bound, bound, shape).astype(np.float32)


class _Conv(Module):
    def __init__(self, in_channels: int, out_channels: int, kernel_size=3, bias: bool = True, seed: int = 0, **attributes: Any) -> None:
        super().__init__(kernel_size=kernel_size, **attributes)
        volume = KernelSpec.of(kernel_size).volume
        fan = in_channels * volume
        self.parameters = {"weight": _uniform((volume, in_channels, out_channels), fan, seed), "bias": _uniform((out_channels,), fan, seed + 1) if bias else None}

    @classmethod
    def _packed(cls, source: _Conv, group_size: int | None, bits: int) -> _Conv:
        out = cls.__new__(cls)
        Module.__init__(out, **source.attributes)
        out.parameters = {"weight": quantize_weight(source.parameters["weight"], group_size, bits), "bias": source.parameters["bias"]}
        return out


class Conv3d(_Conv):
    op = "conv3d"


class SubmConv3d(_Conv):
    op = "subm_conv3d"


class ConvTranspose3d(_Conv):
    op = "conv_transpose3d"

    def __init__(self, in_channels: int, out_channels: int, kernel_size=2, stride=2, **rest: Any) -> None:
        super().__init__(in_channels, out_channels, kernel_size, stride=stride, **rest)


class GenerativeConvTranspose3d(ConvTranspose3d):
    op = "generative_conv_transpose3d"


class _Packed:
    """Made from the module with plain weights."""

    @classmethod
    def from_float(cls, source: _Conv, group_size: int | None = None, bits: int = 4):
        return cls._packed(source, group_size, bits)


class QuantizedConv3d(_Packed, Conv3d):
    pass


class QuantizedSubmConv3d(_Packed, SubmConv3d):
    pass


class QuantizedConvTranspose3d(_Packed, ConvTranspose3d):
    pass


class QuantizedGenerativeConvTranspose3d(_Packed, GenerativeConvTranspose3d):
    pass


class Linear(Module):
    op = "linear"

    def __init__(self, in_channels: int, out_channels: int, bias: bool = True, seed: int = 0) -> None:
        super().__init__()
        self.parameters = {"weight": _uniform((out_channels, in_channels), in_channels, seed), "bias": _uniform((out_channels,), in_channels, seed + 1) if bias else None}


class QuantizedLinear(Linear):
    @classmethod
    def from_float(cls, source: Linear, group_size: int | None = None, bits: int = 4) -> QuantizedLinear:
        out = cls.__new__(cls)
        Module.__init__(out)
        out.parameters = {"weight": quantize_weight(source.parameters["weight"], group_size, bits), "bias": source.parameters["bias"]}
        return out


def _plain(name: str, operator: str) -> type[Module]:
    return type(name, (Module,), {"op": operator, "__doc__": f"``{operator}`` with fixed attributes."})


ReLU, Sigmoid, GELU, SiLU = (_plain(n, o) for n, o in (("ReLU", "relu"), ("Sigmoid", "sigmoid"), ("GELU", "gelu"), ("SiLU", "silu")))
LeakyReLU, Tanh, Softplus = (_plain(n, o) for n, o in (("LeakyReLU", "leaky_relu"), ("Tanh", "tanh"), ("Softplus", "softplus")))
Pool3d, SumPool3d, MaxPool3d, AvgPool3d = (_plain(n, o) for n, o in (("Pool3d", "pool3d"), ("SumPool3d", "sum_pool3d"), ("MaxPool3d", "max_pool3d"), ("AvgPool3d", "avg_pool3d")))
GlobalSumPool, GlobalAvgPool, GlobalMaxPool = (_plain(n, o) for n, o in (("GlobalSumPool", "global_sum_pool"), ("GlobalAvgPool", "global_avg_pool"), ("GlobalMaxPool", "global_max_pool")))


class Dropout(Module):
    """Active in training only; each call in training draws anew."""

    op = "dropout"

    def __init__(self, p: float = 0.5, seed: int = 0) -> None:
        super().__init__(p=p, training=True, seed=seed)

    def train(self, mode: bool = True) -> Dropout:
        self.attributes["training"] = mode
        return self

    def __call__(self, x: LatticeFrame) -> LatticeFrame:
        out = super().__call__(x)
        self.attributes["seed"] += 1
        return out


class BatchNorm(Module):
    """In training uses the rows' statistics and moves the running ones towards them; else uses the running ones."""

    op = "batch_norm"

    def __init__(self, channels: int, eps: float = 1e-5, momentum: float = 0.1) -> None:
        super().__init__(eps=eps)
        self.momentum, self.training = momentum, True
        self.parameters = {"mean": np.zeros(channels), "var": np.ones(channels), "weight": np.ones(channels), "bias": np.zeros(channels)}

    def train(self, mode: bool = True) -> BatchNorm:
        self.training = mode
        return self

    def __call__(self, x: LatticeFrame) -> LatticeFrame:
        if not self.training:
            return super().__call__(x)
        row = batch_statistics(x).first()
        now = {k: np.array([row[f"{k}_{c}"] for c in x.names], np.float64) for k in ("mean", "var")}
        for k, v in now.items():
            self.parameters[k] = (1 - self.momentum) * self.parameters[k] + self.momentum * v
        return ops.batch_norm(x, now["mean"], now["var"], self.parameters["weight"], self.parameters["bias"], self.attributes["eps"])


class LayerNorm(Module):
    op = "layer_norm"

    def __init__(self, channels: int, eps: float = 1e-5) -> None:
        super().__init__(eps=eps)
        self.parameters = {"weight": np.ones(channels), "bias": np.zeros(channels)}


class RMSNorm(Module):
    op = "rms_norm"

    def __init__(self, channels: int, eps: float = 1e-5) -> None:
        super().__init__(eps=eps)
        self.parameters = {"weight": np.ones(channels)}


class Sequential:
    """Modules one after the other."""

    def __init__(self, *modules: Module) -> None:
        self.modules = modules

    def __call__(self, x: LatticeFrame) -> Any:
        for m in self.modules:
            x = m(x)
        return x

    def build(self, graph: Any, x: str) -> str:
        for m in self.modules:
            x = m.build(graph, x)
        return x


MODULES = {n: v for n, v in list(globals().items()) if isinstance(v, type) and issubclass(v, Module) and n[0] != "_" and v is not Module}
