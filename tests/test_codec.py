import numpy as np
import pytest

from loomspan.operators import codec

BLOCKS = {
    "walk": np.cumsum(np.random.default_rng(42).normal(size=(64, 5)), axis=0),
    "constant": np.full((32, 2), 3.5),
    "single": np.array([[1.25]]),
    "bits": np.random.default_rng(1).integers(0, 1 << 32, (40, 3), dtype=np.uint32).view(np.float32),
}


@pytest.mark.parametrize("mode", codec.EXACT)
@pytest.mark.parametrize("name", BLOCKS)
def test_exact_modes_return_every_bit(mode, name):
    a = BLOCKS[name].astype(np.float32)
    assert codec.decode(codec.encode(a, mode)).tobytes() == a.tobytes()
    many = np.tile(a, (3, 1, 1)) * np.float32(1.5)
    back = codec.decode(codec.encode(many, mode))
    assert back.shape == many.shape and back.tobytes() == many.tobytes()


@pytest.mark.parametrize("mode", [m for m in codec.MODES if m not in codec.EXACT])
@pytest.mark.parametrize("name", ["walk", "constant", "single"])
def test_lossy_modes_stay_near(mode, name):
    a = BLOCKS[name].astype(np.float32)
    span = np.ptp(a) or 1
    assert abs(codec.decode(codec.encode(a, mode)) - a).max() <= span * (1 / 200 if mode == "quantized_8" else 2e-3)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_differences_invert_with_wrap_around(order):
    u = np.random.default_rng(order).integers(0, 1 << 32, (20, 2), dtype=np.uint32)
    assert (codec.undeltas(codec.deltas(u, order), order) == u).all()


def test_best_candidate_is_no_larger_than_one_of_them():
    a = BLOCKS["walk"].astype(np.float32)
    assert len(codec.encode(a, "optimal")) <= len(codec.encode(a, "lossless")) + 2


def test_errors():
    with pytest.raises(ValueError):
        codec.encode(np.zeros((2, 2)), "none")
    with pytest.raises(ValueError):
        codec.encode(np.zeros((0, 2)), "lossless")


@pytest.mark.parametrize("t", codec.TRANSFORMS)
@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 9, 3), (4, 7, 2), (3, 2, 1)])
def test_every_transform_inverts(t, shape):
    u = np.random.default_rng(t).integers(0, 1 << 32, shape, dtype=np.uint32)
    forth, back = codec.TRANSFORMS[t]
    assert (back(forth(u), shape) == u).all()


@pytest.mark.parametrize("mode", ["lossless", "lossless_fast", "optimal", "optimal_fast", "raw", "gorilla"])
@pytest.mark.parametrize("kind", [np.float16, np.uint16])
def test_sixteen_bit_floats_keep_their_bits(mode, kind):
    a = np.random.default_rng(3).integers(0, 1 << 16, (3, 8, 2), dtype=np.uint16).view(kind)
    back = codec.decode(codec.encode(a, mode))
    assert back.dtype == kind and back.tobytes() == a.tobytes()
    with pytest.raises(ValueError):
        codec.encode(a, "near_lossless")
    assert codec.widen_bfloat16(np.array([0x3F80, 0xC000], np.uint16)).tolist() == [1.0, -2.0]


def plain_gorilla(words):
    """Bits of the code as text, by its description."""
    bits, lead, trail = f"{words[0]:032b}", 0, 0
    for a, b in zip(words, words[1:]):
        x = f"{a ^ b:032b}"
        if "1" not in x:
            bits += "0"
            continue
        zeros, low = len(x) - len(x.lstrip("0")), len(x) - len(x.rstrip("0"))
        if lead + trail and zeros >= lead and low >= trail:
            bits += "10" + x[lead : 32 - trail]
        else:
            lead, trail = zeros, low
            bits += f"11{lead:05b}{31 - lead - trail:06b}" + x[lead : 32 - trail]
    return bits


@pytest.mark.parametrize("seed", range(4))
def test_gorilla_uses_its_last_window_again(seed):
    rnd = np.random.default_rng(seed)
    a = np.round(np.cumsum(rnd.normal(size=4000)), 1).astype(np.float32) if seed else rnd.normal(size=300).astype(np.float32)
    words = a.view(np.uint32).tolist()
    raw, bits = codec.gorilla_code(words), plain_gorilla(words)
    assert raw == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert codec.gorilla_decode(raw, len(words)) == words


def test_certificates_name_the_winner_and_the_gap():
    from loomspan.operators import entropy

    a = np.cumsum(np.random.default_rng(5).integers(-2, 3, (16, 64, 3)), axis=1).astype(np.float32)
    blob = codec.encode(a, "optimal")
    c = codec.certificate(blob)
    raw = codec.TRANSFORMS[c["transform"]][0](a.view(np.uint32))
    assert codec.COMPRESSORS[c["compressor"]][0](raw) == blob[-c["compressed_size"] :]
    assert c["original_size"] == a.nbytes and c["achieved_bpb"] == 8 * c["compressed_size"] / len(raw)
    counts = np.unique(np.frombuffer(raw, np.uint8), return_counts=True)[1]
    h0 = -sum(n / len(raw) * np.log2(n / len(raw)) for n in counts)
    assert c["entropy"] <= h0 + 1e-9 and c["gap_bpb"] == max(c["achieved_bpb"] - c["entropy"], 0)
    sizes = [len(pack(forth(a.view(np.uint32)))) for t, (forth, _) in codec.TRANSFORMS.items() if t < 16 for pack, _ in codec.COMPRESSORS.values()]
    assert c["compressed_size"] == min(sizes)
    even = np.tile(np.arange(256, dtype=np.uint8), 10)
    assert entropy.chi_squared_p(even) > 0.999 and entropy.chi_squared_p(even[:200]) == 0 and entropy.chi_squared_p(np.zeros(500, np.uint8)) == 0
    with pytest.raises(ValueError):
        codec.certificate(codec.encode(a, "lossless"))


def test_residuals_and_raw_bytes_come_back():
    a = np.random.default_rng(6).normal(size=(2, 5, 3)).astype(np.float32)
    near = np.round(a, 2)
    assert codec.xor_restore(codec.xor_residual(a, near), near).tobytes() == a.tobytes()
    for raw in (b"", b"abc" * 1000, bytes(np.random.default_rng(7).integers(0, 256, 999, np.uint8))):
        assert codec.unpack_bytes(codec.pack_bytes(raw)) == raw
    assert codec.shaped(np.zeros(5)).shape == (1, 5, 1) and codec.shaped(np.zeros((2, 3, 4, 5))).shape == (2, 3, 20)
    with pytest.raises(ValueError):
        codec.unplanes(b"12345", np.uint32)


def test_blobs_of_a_table(spark):
    rows = [(1, [1.0, 2.0, float("nan"), float("inf"), 3.0, 4.0]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id long, values array<float>")
    got = {r.id: r for r in codec.decompress(codec.compress(df, "optimal", 2)).collect()}
    assert got[1]["values"][:3] == [1.0, 2.0, 0.0] and got[1].raw_bytes == 24 and got[2]["values"] is None and got[3]["values"] is None
    made = codec.compress_optimal(df, 2, fast=True).filter("id = 1").first()
    assert made.original_size == 24 and made.compressed_size + codec.HEAD.size + 2 == len(made.blob)
    found = codec.candidates(df.filter("id = 1"), 2).orderBy("rnk").collect()
    assert len(found) == 16 and [r["size"] for r in found] == sorted(r["size"] for r in found)


def test_plain_ways_to_keep_a_table():
    a = np.round(np.cumsum(np.random.default_rng(8).normal(size=(400, 3)), axis=0), 1).astype(np.float32)
    sizes = codec.reference_sizes(a)
    assert sizes["raw"] == a.nbytes and sizes["csv"] > sizes["csv_gzip"] > 0 and sizes["csv_zstd"] < sizes["csv"]
    assert len(codec.encode(a, "optimal")) < sizes["raw"]


def test_sizes_of_all_modes_in_one_pass(spark):
    rows = [(i, [float((i * j * 37) % 101) for j in range(n)]) for i, n in enumerate((16, 16, 5, 1, 16))] + [(9, []), (10, None)]
    df = spark.createDataFrame(rows, "id int, values array<float>")
    got = {}
    for r in codec.sizes(df).collect():
        a, b = got.get(r.mode, (0, 0))
        got[r.mode] = a + r.raw_bytes, b + r.blob_bytes
    for mode in codec.MODES:
        made = codec.compress(df, mode).collect()
        assert got[mode] == (sum(r.raw_bytes for r in made), sum(len(r.blob) for r in made if r.blob))


def test_a_competition_packs_no_candidate_that_cannot_win(monkeypatch):
    a = np.random.default_rng(6).normal(50, 20, (1, 16, 1)).astype(np.float32)
    want, calls = codec.encode(a, "optimal"), []
    own = dict(codec.COMPRESSORS)
    count = lambda c, f: lambda *x: (calls.append(c), f(*x))[1]
    monkeypatch.setattr(codec, "COMPRESSORS", {c: (count(c, f), g) for c, (f, g) in own.items()})
    assert codec.encode(a, "optimal") == want and calls.count(4) == 0 and len(calls) < 60
    made = {(t, c): own[c][0](codec.TRANSFORMS[t][0](a.view(np.uint32))) for t in codec.RIVALS[4] for c in own}
    t, c = min(made, key=lambda k: (len(made[k]), k))
    assert want[codec.HEAD.size :] == bytes([t, c]) + made[t, c]
