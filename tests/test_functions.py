import numpy as np
import pytest
from helpers import feats, frame, line, table
from pyspark.sql import functions as F

from gridstone import ops
from gridstone.functions import entropy
from gridstone.functions.quantized import dequantize_weight, quantize_weight
from gridstone.plans.graph import REGISTRY, GraphBuilder, LatticeModel, Manifest, Node, build_module_artifact, load_model, operation_spec, register, save_model
from gridstone.plans import modules as M


def test_cdf(spark):
    df = spark.createDataFrame([([1 / 16] * 16,)], "p array<float>").select(entropy.normalized_cdf(F.col("p")).alias("c"))
    assert df.first()["c"] == [4096 * i for i in range(17)]
    rng = np.random.default_rng(0)
    p = rng.random((20, 7)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(p)], "i long, p array<float>").select("i", entropy.normalized_cdf(F.col("p")).alias("c"))
    assert [r["c"] for r in sorted(rows.collect())] == entropy.cdf_rows(p).tolist()
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([float("nan"), 1.0],)], "p array<float>").select(entropy.normalized_cdf(F.col("p"))).collect()


def test_coders_round_trip():
    rng = np.random.default_rng(7)
    p = rng.dirichlet(np.full(9, 0.2), 2048).astype(np.float32)
    s = rng.integers(0, 9, 2048).tolist()
    r = entropy.range_encode_from_prob(p, s)
    assert entropy.range_decode_from_prob(p, r) == s and r == entropy.range_encode(entropy.cdf_rows(p), s)
    q = entropy.rans_encode_from_prob(p, s)
    assert entropy.rans_decode_from_prob(p, q) == s
    for bad in (q[:-1], q + b"x"):
        with pytest.raises(ValueError):
            entropy.rans_decode_from_prob(p, bad)
    with pytest.raises(ValueError):
        entropy.range_decode_from_prob(p[:5], r)
    with pytest.raises(ValueError):
        entropy.range_encode_from_prob(p[:1], [9])
    likely = np.tile(np.float32([0.97, 0.01, 0.01, 0.01]), (2048, 1))
    assert len(entropy.range_encode_from_prob(likely, [0] * 2048)) < 64


@pytest.mark.parametrize("bits", [4, 8])
def test_quantized(spark, bits):
    rng = np.random.default_rng(3)
    for shape in ((5, 40), (27, 40, 3), (3, 3, 3, 3, 40)):
        w = rng.standard_normal(shape).astype(np.float32)
        q = quantize_weight(w, 32, bits)
        assert dequantize_weight(q).shape == w.shape
        assert np.abs(dequantize_weight(q) - w).max() <= q.scales.max() * 0.51
    x = frame(spark, [(0, 0, 0, 0)], [[float(i) for i in range(40)]])
    q = quantize_weight(rng.standard_normal((5, 40)), 32, bits)
    assert feats(ops.linear(x, q)) == feats(ops.linear(x, dequantize_weight(q)))


def test_every_operator_is_registered():
    assert all(f"ops.{n}" in REGISTRY for n in ops.OPERATORS) and len(ops.OPERATORS) >= 81
    aliases = [n for n in REGISTRY if not n.startswith("ops.")]
    assert len(aliases) == 26 and operation_spec("feature.linear").rename == {"input": "x"}
    assert len(M.MODULES) == 28


def _graph():
    g = GraphBuilder()
    x = g.input("x")
    y = g.call("subm_conv3d", x, {"weight": g.add_parameter("w", np.ones((27, 1, 2)))}, kernel_size=3)
    y = g.add_op("feature.relu", {"input": y})
    g.output(g.add_op("ops.global_sum_pool", {"x": y}, output="pooled"), "dense_tensor")
    return g


def test_graph_round_trip(spark, tmp_path):
    g = _graph()
    q = quantize_weight(np.ones((2, 32)), 32, 4)
    g.add_parameter("q", q)
    model = LatticeModel(g.manifest(), g.parameters)
    x = line(spark)
    want = table(model(x=x)["pooled"], "batch", "f0", "f1")
    save_model(spark, str(tmp_path / "m"), model)
    again = load_model(spark, str(tmp_path / "m"))
    assert again.manifest == model.manifest and table(again(x=x)["pooled"], "batch", "f0", "f1") == want
    assert (dequantize_weight(again.parameters["q"]) == dequantize_weight(q)).all()


def test_graph_rejects(spark):
    with pytest.raises(KeyError):
        GraphBuilder().add_op("ops.nothing", {})
    for nodes, outputs in (
        ([Node("a", "ops.relu", {"x": "y"}, "z")], {}),
        ([Node("a", "ops.relu", {"x": "x"}, "x")], {}),
        ([Node("a", "ops.relu", {"x": "x"}, "z", {"weight": "w"})], {}),
        ([], {"z": "any"}),
    ):
        with pytest.raises(ValueError):
            Manifest({"x": "any"}, outputs, nodes).check(set())
    with pytest.raises(ValueError):
        Manifest({}, {}, [], schema_version="0").check()
    g = _graph()
    with pytest.raises(ValueError):
        LatticeModel(g.manifest(), {})
    with pytest.raises(ValueError):
        LatticeModel(g.manifest(), g.parameters)(y=line(spark))
    with pytest.raises(ValueError):
        LatticeModel(g.manifest(), g.parameters)(x=b"")


def test_own_operation(spark):
    @register("own.double")
    def double(x):
        return x.project(lambda c: c * 2)

    g = GraphBuilder("float")
    g.output(g.add_op("own.double", {"x": g.input("x")}, output="y"))
    y = LatticeModel(g.manifest(), g.parameters)(x=line(spark))["y"]
    assert feats(y) == [(2,), (4,), (6,)] and y.dtype == "float"
    del REGISTRY["own.double"]


def test_modules_equal_functions(spark):
    x = line(spark, feats=[[1, 2], [3, 4], [5, 6]])
    conv = M.SubmConv3d(2, 3, (3, 1, 1))
    assert feats(conv(x)) == feats(ops.subm_conv3d(x, conv.parameters["weight"], conv.parameters["bias"], (3, 1, 1)))
    net = M.Sequential(conv, M.ReLU(), M.LayerNorm(3), M.Linear(3, 2))
    assert np.array(feats(build_module_artifact(net)(x=x)[net_output(net)])) == pytest.approx(np.array(feats(net(x))))
    packed = M.QuantizedSubmConv3d.from_float(conv, 32, 8)
    assert np.array(feats(packed(x))) == pytest.approx(np.array(feats(conv(x))), abs=0.05)
    norm = M.BatchNorm(2)
    norm(x)
    assert norm.parameters["mean"] == pytest.approx([0.3, 0.4])
    assert feats(norm.train(False)(x)) == feats(ops.batch_norm(x, **norm.parameters))
    assert feats(M.MaxPool3d(kernel_size=2)(x)) == feats(ops.max_pool3d(x))


def net_output(net):
    return next(iter(build_module_artifact(net).manifest.outputs))


def test_sources_and_streaming(spark, tmp_path):
    from gridstone.sources.tables import read_lattice, write_lattice
    from gridstone.streaming.voxels import stream_voxels

    x = line(spark)
    write_lattice(x, str(tmp_path / "l"), 2)
    assert sorted(read_lattice(spark, str(tmp_path / "l")).df.collect()) == sorted(x.df.collect())
    p = spark.createDataFrame([(0, 0, 0.1, 0.0, 0.0, 1.0), (1, 0, 0.9, 0.0, 0.0, 2.0), (2, 0, 1.5, 0.0, 0.0, 4.0)], "point_id long, batch int, px float, py float, pz float, f0 double")
    p.write.parquet(str(tmp_path / "p"))
    s = stream_voxels(spark.readStream.schema(p.schema).parquet(str(tmp_path / "p")))
    q = s.writeStream.format("memory").queryName("vox_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert table(spark.table("vox_stream"), "x", "count", "f0") == [(0, 2, 3), (1, 1, 4)]
