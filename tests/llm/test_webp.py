import hashlib
import zlib

import numpy as np
import pytest

from inkgauge.llm import media, webp, webp_write
from tests.llm.webp_writer import encode


def picture(colours: int, seed: int = 1, h: int = 23, w: int = 31) -> np.ndarray:
    rng = np.random.default_rng(seed)
    shades = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    image = shades[rng.integers(0, colours, (h, w))]
    image[5:9] = image[1:5]  # something to refer back to
    return image


@pytest.mark.parametrize("transforms", ["", "p", "c", "g", "i", "pcg", "gpc", "ip"])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"matches": True}, {"cache_bits": 7, "matches": True, "group_bits": 3}])
def test_round_trip(transforms, options):
    image = picture(200 if "i" not in transforms else 13)
    assert (webp.decode(encode(image, transforms, **options)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 250])
def test_palettes(colours):
    image = picture(colours)
    assert (webp.decode(encode(image, "i")) == image).all()


def samples(kind: str, n: int = 4096) -> np.ndarray:
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, n, dtype=np.uint8)
    made = {
        "noise": noise, "zeros": noise * 0, "text": np.frombuffer(("the cat sat on the mat; " * n).encode()[:n], np.uint8),
        "ramp": np.repeat(np.arange(n // 4), 4).astype(np.uint8), "few": noise[:64][np.repeat(rng.integers(0, 8, n // 4), 4) * 4 + np.tile(np.arange(4), n // 4)],
        "walk": np.cumsum(rng.integers(-2, 3, (n // 4, 4)), 0).astype(np.uint8).reshape(-1), "wide": np.frombuffer(("한국어 본문 é " * n).encode()[:n], np.uint8),
        "grey": np.repeat(noise[: n // 4], 4),
    }
    return made[kind]


KINDS = ("noise", "zeros", "text", "ramp", "few", "walk", "wide", "grey")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("rows", [1, 2, 17, 64])
def test_writer_round_trip(kind, rows):
    image = samples(kind)[: rows * 64].reshape(-1, 16, 4)
    assert (webp.decode(webp_write.encode(image)) == image).all()


def test_writer_uses_every_transform():
    kinds = set()
    for kind in KINDS:
        kinds |= {u[0] for u in webp.open_stream(webp.chunk(webp_write.encode(samples(kind).reshape(-1, 16, 4)))).undo}
    assert kinds == {0, 1, 3}


def test_files_in_step_equal_files_alone():
    images = [samples(k)[: 64 * rows].reshape(-1, 16, 4) for k in KINDS for rows in (1, 5, 33, 64)]
    found = [webp_write.encode(x) for x in images]
    for transforms in ("", "p", "c", "g", "i", "pcg"):  # other writers: other caches, widths, groups
        for options in ({}, {"cache_bits": 11, "matches": True}, {"group_bits": 3, "matches": True}):
            images.append(picture(200 if transforms != "i" else 13))
            found.append(encode(images[-1], transforms, **options))
    broken = found[0][:20] + found[0][20 : len(found[0]) // 2]
    got = webp.decode_many([*found, broken, b"nothing"])
    assert len(found) > webp.STEP_IMAGES and all((a == b).all() for a, b in zip(got, images, strict=False))
    assert all(isinstance(x, Exception) for x in got[len(found) :])
    alone = webp.decode_many(found[:3])
    assert all((a == b).all() for a, b in zip(alone, images, strict=False))


@pytest.mark.parametrize("mode", range(14))
def test_predictions_by_wavefront(mode):
    rng = np.random.default_rng(mode)
    h, w = 9, 11
    argb = rng.integers(0, 2**32, h * w, dtype=np.uint32)
    got = webp.channels(webp.add_predictions(argb, w, h, np.full(9, mode << 8, np.uint32), 2)).reshape(h, w, 4)
    want = webp.channels(argb).reshape(h, w, 4).copy()
    for y in range(h):
        for x in range(w):
            k = want.reshape(-1, 4)
            i = y * w + x
            p = np.array([255, 0, 0, 0]) if not i else k[i - 1] if not y else k[i - w] if not x else webp.predicted(mode, k[i - 1], k[i - w], k[i - w + 1], k[i - w - 1])
            k[i] = k[i] + p & 0xFF
    assert (got == want).all()


@pytest.mark.parametrize("cut", [0, 5, 20, 40, 200])
def test_broken_files_are_refused(cut):
    data = encode(picture(50))
    with pytest.raises((webp.BadImage, ValueError, IndexError)):
        webp.decode(data[:cut])


def test_payloads():
    for text in (None, "", "x", "é" * 64, "\0 a", "y" * 1_100_000):
        body = media.payload(text)
        assert len(body) % 64 == 0 and body
        got = [webp.decode(f) for f in media.files(media.images(body))]
        assert np.concatenate(got).tobytes() == body


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc", "m"), (None, None, None), (1, "abc", "m")], "doc_id long, text string, media string")
    found = media.decode_media(media.store(df)).collect()
    assert [r["n_bytes"] for r in found] == [3, 0, 3] and bytes(found[0]["pixels"])[:3] == b"abc"
    assert found[0]["media_sha256"] == found[2]["media_sha256"] and found[1]["payload_bytes"] == 64
    bad = spark.createDataFrame([(b"nothing",), (None,)], "media binary")
    assert [r["media_error"] is not None for r in media.decode_media(bad).collect()] == [True, True]
    assert media.decode_media(media.store(df.limit(0))).count() == 0


def test_fixed_tables():
    assert len(webp.DISTANCES) == len(set(webp.DISTANCES)) == 120 and sorted(webp.LENGTH_ORDER) == list(range(19))


def test_query_against_plain_python(spark, tmp_path):
    texts = [None, "", "a", "é" * 64, "abc " * 20_000, "한국어 본문\n" * 300, "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        body = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r, a = got[i], np.frombuffer(body, np.uint8)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        sums = ",".join(str(int(a[k::4].sum(dtype=np.int64))) for k in range(4))
        assert r["feature"] == f"16x{len(body) // 64};sum={sums};hist=" + ",".join(str(int((a // 16 == k).sum())) for k in range(16))
        stored = media.images(body)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
