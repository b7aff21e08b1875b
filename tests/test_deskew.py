"""The geometry of skewed pages: threshold, rectangle, rotation, and whole images through Spark."""

import numpy as np
import pytest

from docscreen.operators import deskew
from docscreen.plans.fixtures import IMAGE, draw_page


def page(degrees, channels=1):
    g = np.frombuffer(draw_page(degrees), np.uint8).reshape(200, 240, 1)
    return np.repeat(g, channels, axis=2)


def test_otsu_parts_two_classes():
    rng = np.random.default_rng(0)
    pixels = np.concatenate([rng.normal(60, 9, 3000), rng.normal(190, 12, 9000)]).clip(0, 255).astype(np.uint8)
    plain = max(range(256), key=lambda t: (pixels <= t).mean() * (pixels > t).mean() * (pixels[pixels <= t].mean() - pixels[pixels > t].mean()) ** 2 if 0 < (pixels <= t).sum() < len(pixels) else 0)
    assert abs(deskew.otsu(pixels) - plain) <= 1 and 80 < deskew.otsu(pixels) < 160
    assert deskew.otsu(np.full((4, 4), 7, np.uint8)) == 0


def test_hull_and_least_rectangle_against_brute_force():
    rng = np.random.default_rng(1)
    for k in range(20):
        points = rng.integers(0, 30, (3 + 4 * k, 2))
        corners = deskew.hull(points)
        # No point lies outside of any side.
        side = np.roll(corners, -1, axis=0) - corners
        outside = side[:, :1] * (points[:, 1] - corners[:, 1:]) - side[:, 1:] * (points[:, 0] - corners[:, :1])
        assert (outside >= -1e-9).all()

        def area(degrees, points=points):
            a = np.radians(degrees)
            turn = points @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
            return np.prod(np.ptp(turn, axis=0))

        assert area(deskew.least_rectangle(points)) <= min(area(d) for d in np.arange(0, 90, 0.25)) + 1e-6
    assert deskew.least_rectangle(np.array([[0, 0], [2, 2]])) == pytest.approx(45) and deskew.least_rectangle(np.array([[3, 3]])) == 0


def test_rotation():
    image = page(0, 3)
    assert (deskew.rotate(image, 0.0) == image).all()
    quarter = deskew.rotate(np.arange(49, dtype=np.uint8).reshape(7, 7), 90.0)
    assert (quarter == np.rot90(np.arange(49).reshape(7, 7))).all()
    assert (deskew.rotate(np.full((9, 5), 77, np.uint8), 17.0) == 77).all()  # the border goes on beyond it
    back = deskew.rotate(page(20)[..., 0], 20.0)
    assert np.abs(back.astype(int) - page(0)[..., 0]).mean() < 12 < np.abs(page(20)[..., 0].astype(int) - page(0)[..., 0]).mean()


def test_pages_are_straightened(spark):
    angles = [0, 0.3, 1, -7.5, 22, -29, 35, 80]
    rows = [(k, ("o", 200, 240, c, 16, page(a, c).tobytes())) for k, a in enumerate(angles) for c in (1, 3)]
    rows += [(100, None), (101, ("o", 200, 240, 1, 0, bytes([255] * 200 * 240))), (102, ("o", 5, 5, 1, 0, bytes(range(25))))]
    found = deskew.with_skew(spark.createDataFrame(rows, f"id int, {IMAGE}"))
    left = deskew.with_skew(deskew.straighten(found), name="left")
    got = {}
    for r in left.collect():
        got.setdefault(r.id, []).append((r.skew_angle, r.left_angle, r.image))
    for k, a in enumerate(angles):
        want = a if abs(a) <= 30 else -10 if a == 80 else 0  # a page turned by 80 degrees looks like one turned by -10 that stands on its side
        for angle, rest, image in got[k]:
            assert abs(angle - want) < 0.5 and abs(rest) <= 0.5 or want == -10 or a == 35 and angle == 0, (a, angle, rest)
            assert angle or bytes(image.data) == page(a, image.nChannels).tobytes()
    assert got[100] == [(None, None, None)] and got[102][0][0] == 0.0


def test_only_uneven_pixels_are_resampled(monkeypatch):
    """The turned page is that of the plain kernel over all pixels, at a fraction of its work."""
    rng, worked, cubic = np.random.default_rng(2), [], deskew._cubic
    monkeypatch.setattr(deskew, "_cubic", lambda t: worked.append(t.size) or cubic(t))

    def plain(pixels, degrees):
        (height, width), (c, s) = pixels.shape, (np.cos(np.radians(degrees)), np.sin(np.radians(degrees)))
        cx, cy, (y, x) = width // 2, height // 2, np.mgrid[0:height, 0:width]
        at_x, at_y = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy
        left, up = np.floor(at_x).astype(int), np.floor(at_y).astype(int)
        wx, wy = cubic(at_x - left), cubic(at_y - up)
        taps = ((wy[j] * wx[i]).astype(np.float32) * pixels[np.clip(up + j - 1, 0, height - 1), np.clip(left + i - 1, 0, width - 1)].astype(np.float32) for j in range(4) for i in range(4))
        return np.clip(np.rint(sum(taps, np.zeros(pixels.shape, np.float32))), 0, 255).astype(np.uint8)

    for image in (page(20)[..., 0], rng.integers(0, 256, (61, 47)).astype(np.uint8), np.full((3, 200), 9, np.uint8), np.array([[1, 250]], np.uint8)):
        for degrees in (-20.0, 3.37, 90.0, 133.0):
            assert (deskew.rotate(image, degrees) == plain(image, degrees)).all()
    worked.clear()
    deskew.rotate(page(20)[..., 0], 20.0)
    assert sum(worked) < 2 * 200 * 240 / 4


def test_left_of_the_skew_without_the_turned_images(spark):
    rows = [(k, ("o", 200, 240, c, 16, page(a, c).tobytes())) for k, a in enumerate((0, -7.5, 22, 35)) for c in (1, 3)] + [(100, None)]
    found = deskew.with_skew(spark.createDataFrame(rows, f"id int, {IMAGE}"))
    direct, whole = deskew.with_skew(found, name="left", turned="skew_angle", pixels=False), deskew.with_skew(deskew.straighten(found), name="left")
    assert direct.columns == [c for c in whole.columns if c != "image"]
    assert sorted(map(str, direct.collect())) == sorted(map(str, whole.drop("image").collect()))
