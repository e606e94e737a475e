import struct

import numpy as np

from sparkglyph.sources import images


def java_image(spark, gray, color):
    io = spark._jvm.java.io
    image = spark._jvm.javax.imageio.ImageIO.read(io.ByteArrayInputStream(images.encode(gray)))
    if not color:
        return image
    kind = spark._jvm.java.awt.image.BufferedImage
    out = kind(image.getWidth(), image.getHeight(), kind.TYPE_INT_RGB)
    out.createGraphics().drawImage(image, 0, 0, None)
    return out


def save(spark, gray, path, kind, color=False, interlaced=False):
    """Write an image with Java's encoders."""
    io = spark._jvm.javax.imageio
    writer = io.ImageIO.getImageWritersByFormatName(kind).next()
    how = writer.getDefaultWriteParam()
    if interlaced:
        how.setProgressiveMode(io.ImageWriteParam.MODE_DEFAULT)
    stream = io.ImageIO.createImageOutputStream(spark._jvm.java.io.File(str(path)))
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(java_image(spark, gray, color), None, None), how)
    stream.close()


def turned(raw, value, order):
    """The JPEG with an EXIF orientation."""
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, value, 0, 0)
    body = b"Exif\0\0" + tiff
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + raw[2:]


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.rint(40 + 150 * x / w + 50 * y / h).astype(np.uint8)


def test_photos_are_read_and_turned(spark, tmp_path):
    gray = smooth(40, 56)
    save(spark, gray, tmp_path / "gray.jpg", "jpg")
    save(spark, gray, tmp_path / "color.JPEG", "jpg", color=True)
    raw = (tmp_path / "gray.jpg").read_bytes()
    for value in range(1, 9):
        (tmp_path / f"turn{value}.jpe").write_bytes(turned(raw, value, "<>"[value % 2]))
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8 no image")
    (tmp_path / "page.png").write_bytes(images.encode(gray))
    rows = {r.source.rsplit("/", 1)[1]: r for r in images.read_pages(spark, str(tmp_path)).collect()}
    assert len(rows) == 12 and rows["bad.jpg"].error and rows["bad.jpg"].gray is None
    page = lambda name: np.frombuffer(rows[name].gray, np.uint8).reshape(rows[name].h, rows[name].w).astype(int)
    for name in ("gray.jpg", "color.JPEG", "page.png", "turn1.jpe"):
        assert np.abs(page(name) - gray).max() <= 6, name
    # where the stored corner (0, 0) belongs, by the standard: and the shape that follows
    corner = {1: (0, 0), 2: (0, -1), 3: (-1, -1), 4: (-1, 0), 5: (0, 0), 6: (0, -1), 7: (-1, -1), 8: (-1, 0)}
    far = {1: (0, -1), 2: (0, 0), 3: (-1, 0), 4: (-1, -1), 5: (-1, 0), 6: (-1, -1), 7: (0, -1), 8: (0, 0)}
    for value in corner:
        turn = page(f"turn{value}.jpe")
        assert turn.shape == ((40, 56) if value < 5 else (56, 40))
        assert abs(turn[corner[value]] - int(gray[0, 0])) <= 6 and abs(turn[far[value]] - int(gray[0, -1])) <= 6, value
    only = images.read_pages(spark, str(tmp_path), "gray*").collect()
    assert [r.source.rsplit("/", 1)[1] for r in only] == ["gray.jpg"]


def test_orientation_of_broken_files():
    assert [images.orientation(x) for x in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00\x09Exif\0\0I", turned(b"\xff\xd8", 9, "<"), turned(b"\xff\xd8", 6, ">"))] == [1, 1, 1, 1, 6]


def test_interlaced(spark, tmp_path):
    for h, w in ((1, 1), (3, 5), (40, 57)):
        gray = smooth(h, w)
        for color in (False, True):
            save(spark, gray, tmp_path / "i.png", "png", color, interlaced=True)
            raw = (tmp_path / "i.png").read_bytes()
            assert raw[28] == 1 and (images.decode(raw) == gray).all()
