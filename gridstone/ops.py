"""Every public operator by name."""

from __future__ import annotations

from gridstone.functions.entropy import (
    normalized_cdf,
    range_decode,
    range_decode_from_prob,
    range_encode,
    range_encode_from_prob,
    rans_decode_from_prob,
    rans_encode_from_prob,
)
from gridstone.functions.quantized import QuantizedWeight, dequantize_weight, quantize_weight, quantized_matmul
from gridstone.geometry import KernelSpec, kernel_offsets
from gridstone.operators.algebra import (
    align_sparse,
    build_sparse_alignment,
    cat,
    gather_aligned_features,
    sparse_add,
    sparse_binary_op,
    sparse_cat_aligned,
    sparse_maximum,
    sparse_minimum,
    sparse_mul,
    sparse_sub,
)
from gridstone.operators.conv import conv3d, conv_transpose3d, generative_conv_transpose3d, subm_conv3d
from gridstone.operators.coords import (
    child_coords_from_indices,
    contains_coords,
    downsample_coords,
    intersection_coords,
    inverse_map,
    lookup_coords,
    morton_codes,
    morton_order,
    morton_sort_coords,
    occupancy_downsample,
    occupancy_expand,
    union_coords,
)
from gridstone.operators.features import (
    batch_norm,
    dropout,
    gelu,
    layer_norm,
    leaky_relu,
    linear,
    relu,
    replace_feature,
    rms_norm,
    sigmoid,
    silu,
    softplus,
    tanh,
)
from gridstone.operators.points import (
    SparseQuantization,
    build_point_voxel_map,
    devoxelize,
    interpolate_point_features,
    sparse_quantize,
    voxelize,
    voxelize_with_quantization,
)
from gridstone.operators.pool import avg_pool3d, global_avg_pool, global_max_pool, global_sum_pool, max_pool3d, pool3d, sum_pool3d
from gridstone.operators.relations import (
    Relation,
    RelationCache,
    build_generative_relation,
    build_kernel_relation,
    build_knn_relation,
    build_radius_relation,
    build_submanifold_kernel_relation,
    build_target_kernel_relation,
    build_transposed_kernel_relation,
    gather_neighbor_features,
    generative_kernel_relation,
    kernel_relation,
    knn_relation,
    radius_relation,
    submanifold_kernel_relation,
    target_kernel_relation,
    transposed_kernel_relation,
)
from gridstone.operators.rows import crop, prune, prune_mask, sparse_collate, topk_rows

#: Classes among the names here; all else is an operator.
VALUES = (KernelSpec, QuantizedWeight, Relation, RelationCache, SparseQuantization)

OPERATORS = {
    name: value
    for name, value in sorted(globals().items())
    if callable(value) and value not in VALUES and getattr(value, "__module__", "").startswith("gridstone.")
}
__all__ = [*OPERATORS, *(v.__name__ for v in VALUES)]


def backend_info() -> dict[str, str]:
    """Versions of this package and of Spark."""
    import pyspark

    return {"name": "gridstone", "version": "0.1.0", "spark": pyspark.__version__}
