"""A fitted pixel classifier applied inside the patch row: bands go in, an image of probabilities comes out, and no
pixel becomes a row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Net:
    """Layer sizes and weights of a perceptron as Spark ML lays them out: for each layer its matrix by columns
    (a column per input), then its biases. It goes to the tasks with the expression: 134 KB for 64 bands."""

    layers: list[int]
    weights: np.ndarray

    @classmethod
    def of(cls, model) -> Net:
        """From a fitted ``MultilayerPerceptronClassificationModel``."""
        return model if isinstance(model, cls) else cls(list(model.getLayers()), model.weights.toArray())

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        """Of the second class, for features by row: sigmoid hidden layers, softmax of two at the end."""
        at = 0
        for n, (inputs, outputs) in enumerate(zip(self.layers, self.layers[1:], strict=False), 2):
            end = at + inputs * outputs
            features = features @ self.weights[at:end].reshape(inputs, outputs) + self.weights[end : end + outputs]
            at = end + outputs
            if n < len(self.layers):
                features = _sigmoid(features)
        return _sigmoid(features[:, 1] - features[:, 0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1, small) / (1 + small)


def normalized(features: np.ndarray, epsilon: float = 1e-3) -> np.ndarray:
    """Zero mean and unit variance over one pixel's features, as ``bands.layer_norm`` has it."""
    centred = features - features.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + epsilon)


def scaling(size: int, k: int) -> np.ndarray:
    """The matrix S for which S @ image @ S.T is the image averaged over k x k blocks and brought back to full size,
    bilinear with centres at half pixels, as ``bands.multi_scale`` has it."""
    if size % k:
        raise ValueError(f"{size} is not divisible by {k}")
    small = size // k
    place = (np.arange(size) + 0.5) / k - 0.5
    low = np.floor(place).astype(int)
    out = np.zeros((size, small))
    for at, part in ((low, 1 - (place - low)), (low + 1, place - low)):
        np.add.at(out, (np.arange(size), np.clip(at, 0, small - 1)), part)
    return out @ np.kron(np.eye(small), np.full((1, k), 1 / k))


def image_scores(
    bands: list[Column], net: Net, size: int, scales: tuple[int, ...] = (1,), layer_norm: bool = False, values: T.DataType | None = None
) -> Column:
    """The net's image for a row's bands of ``size * size`` values; its features are each band at each scale. A task
    holds one Arrow batch and the activations of one row: ``size * size`` by the widest layer. A missing or short band
    is an error; a NaN in any band makes that pixel's score NaN (with several scales also those of its
    neighbours), which no threshold is below."""
    kind, n, pixels = values or T.DoubleType(), len(bands), size * size
    if n * len(scales) != net.layers[0]:
        raise ValueError(f"the net has {net.layers[0]} inputs, not {n * len(scales)}")
    matrices = [scaling(size, k) for k in scales]

    @F.arrow_udf(T.ArrayType(kind))
    def scored(images: pa.Array) -> pa.Array:
        flat = images.flatten()
        if images.null_count or flat.null_count or (flat.value_lengths().to_numpy(zero_copy_only=False) != pixels).any():
            raise ValueError(f"a patch has not {n} bands of {pixels} values")
        block = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(images), n, size, size)
        out = np.empty((len(images), pixels), dtype="f8" if isinstance(kind, T.DoubleType) else "f4")
        for row, given in enumerate(block):
            own = given.astype("f8")
            scaled = own[:, None] if scales == (1,) else np.stack([own if k == 1 else m @ own @ m.T for k, m in zip(scales, matrices, strict=True)], axis=1)
            features = scaled.reshape(n * len(scales), pixels).T
            out[row] = net.probabilities(normalized(features) if layer_norm else features)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(images) + 1, dtype=np.int32) * pixels), pa.array(out.ravel()))

    return scored(F.array(*bands))
