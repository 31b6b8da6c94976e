from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from changerisk.llm import media


def bmp(image, bottom_up=True):
    rows = image[::-1] if bottom_up else image
    body = b"".join(r[:, ::-1].tobytes().ljust((image.shape[1] * 3 + 3) // 4 * 4, b"\0")
                    for r in rows)
    height = image.shape[0] if bottom_up else -image.shape[0]
    return (b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54)
            + struct.pack("<IiiHHIIiiII", 40, image.shape[1], height, 1, 24, 0, len(body), 0, 0, 0,
                          0) + body)


def test_formats():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for up in (True, False):
        assert (media.decode_image(bmp(rgb, up)) == rgb).all()
    assert (media.decode_image(b"P6 7 # seven\n5\n255\n" + rgb.tobytes()) == rgb).all()
    grey = rgb[:, :, 0]
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all()
    text = b"P2\n7 5\n255\n" + b" ".join(b"%d" % v for v in grey.ravel())
    assert (media.decode_image(text) == grey).all()
    assert (media.decode_image(b"P1 3 2 1 0 1 0 1 0") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode_image(b"P4 3 2\n\xa0\x40") == [[0, 255, 0], [255, 0, 255]]).all()
    wide = np.array([[1, 40000]], dtype=np.uint16)
    assert (media.decode_image(b"P5 2 1 65535\n" + wide.astype(">u2").tobytes()) == wide).all()


@pytest.mark.parametrize("shape", [(1, 64), (3, 5), (40, 64), (8, 9)])
def test_area_resize(shape):
    image = np.random.default_rng(1).random(shape)
    h, w = 8, 9
    big = np.kron(image, np.ones((h, w)))  # every cell is now whole
    slow = big.reshape(h, shape[0], w, shape[1]).mean(axis=(1, 3))
    assert media.area_resize(image, h, w) == pytest.approx(slow)


def test_texts(spark, odd_docs, no_docs):
    extra = odd_docs.withColumnRenamed("lang", "media")
    made = media.text_images(extra)
    rows = [r.asDict() | {"media": bytes(r["media"])} for r in made.collect()]
    assert len(rows) == odd_docs.count()
    got = media.media_features(made).collect()
    for r in got:
        assert r["error"] is None and r["samples"] % 64 == 0 and r["samples"] >= 64
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in got:
        if r["key"] in (2, 3, 4, 6):
            raw = (texts[r["key"]] or "").encode()
            padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            assert r["n_bytes"] == len(raw)
            assert r["samples_sha256"] == hashlib.sha256(padded).hexdigest()
            assert r["tail_crc32"] == zlib.crc32(padded[-64:])
            assert np.load(io.BytesIO(r["tile"])).shape == (32, 32)
    assert media.media_features(media.text_images(no_docs)).count() == 0


def test_bad_bytes(spark):
    df = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"P5 9 9 255\nshort"), (4, b"")],
                               "key int, media binary")
    got = media.media_features(df).collect()
    assert len(got) == 4 and all(r["error"] and r["feature"] is None for r in got)


def test_names_the_input_has(spark):
    images = media.text_images(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    clashing = images.selectExpr("key", "media", "'mine' AS feature", "7 AS samples")
    got = media.media_features(clashing)
    row = got.first()
    assert (row["feature"], row["samples"]) == ("mine", 7)
    assert len(row["feature_1"]) > 0 and row["samples_1"] == 64
