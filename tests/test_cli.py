import json

import pytest

from sparkglyph.__main__ import DONE, UNREAD, WRONG, found, main
from sparkglyph.plans import truth
from sparkglyph.sources import fonts, images

TEXT = ["ana lune dal cos", "nade ula ensi co", "daun lea nad gos", "una alde dan cis"]


def photos(path, n=2, **hand):
    for k in range(n):
        (path / f"page{k}.png").write_bytes(images.encode(truth.draw(TEXT, truth.Hand(**hand), k)[0]))
    return str(path / "page*.png")


def test_font_from_free_pages(spark, tmp_path, capsys):
    pattern = photos(tmp_path)
    rows = [{"source": f"page{p}.png", "line_index": k, "text": t, "confidence": 0.9} for p in range(2) for k, t in enumerate(TEXT)]
    (tmp_path / "texts.json").write_text("\n".join(map(json.dumps, rows)))
    out = tmp_path / "made" / "own.ttf"
    assert main(["read", pattern, "--texts", str(tmp_path / "texts.json"), "--scanned", "-o", str(out), "--dump", str(tmp_path / "dump"), "--preview", "--show-text"]) == DONE
    assert set("".join(TEXT)) <= set(map(chr, fonts.parse(out.read_bytes())["codes"]))
    said = capsys.readouterr().out.splitlines()
    assert said[: len(TEXT)] == TEXT and "characters from" in said[2 * len(TEXT)]
    assert (images.decode((tmp_path / "made" / "own.png").read_bytes()) == 0).any() and list((tmp_path / "dump").iterdir())
    assert main(["preview", str(out), "--text", "ana dal", "-o", str(tmp_path / "p.png")]) == DONE
    assert (images.decode((tmp_path / "p.png").read_bytes()) == 0).any()


def test_font_from_worksheets(spark, tmp_path):
    (tmp_path / "text.txt").write_text("\n\n".join(t + "  " for t in TEXT))
    assert main(["sheets", str(tmp_path / "text.txt"), "-o", str(tmp_path / "sheets")]) == DONE
    geometry = json.loads((tmp_path / "sheets" / "sheets.json").read_text())["sheets"]
    bands = geometry[0]["bands"]
    assert [b["text"] for b in bands] == TEXT and len(geometry) == 1
    pitch = bands[1]["baseline_y"] - bands[0]["baseline_y"]
    pattern = photos(tmp_path, 1, pitch=pitch, margin=bands[0]["write_rect"]["y0"] - 15)
    out = tmp_path / "sheet.ttf"
    assert main(["build", str(tmp_path / "sheets" / "sheets.json"), pattern, "-o", str(out)]) == DONE
    assert set("".join(TEXT)) <= set(map(chr, fonts.parse(out.read_bytes())["codes"]))


def test_wrong_use(spark, tmp_path, capsys):
    pattern = photos(tmp_path, 1)
    assert main(["read", str(tmp_path / "none.png"), "--reader", "a:b"]) == WRONG
    assert "page0.png" in capsys.readouterr().err
    assert main(["read", pattern]) == WRONG
    assert main(["build", str(tmp_path / "none.json"), pattern]) == WRONG
    assert main(["preview", str(tmp_path / "none.ttf")]) == WRONG
    assert main(["sheets", str(tmp_path / "none.txt")]) == WRONG
    with pytest.raises(SystemExit) as ended:
        main(["read"])
    assert ended.value.code == 2
    (tmp_path / "texts.json").write_text(json.dumps({"source": "page0.png", "line_index": 0, "text": "", "confidence": 0.0}))
    assert main(["read", pattern, "--texts", str(tmp_path / "texts.json"), "--scanned", "-o", str(tmp_path / "x.ttf")]) == UNREAD
    assert not (tmp_path / "x.ttf").exists()


def test_patterns_name_each_file_once(tmp_path):
    for name in ("b.png", "a.png"):
        (tmp_path / name).write_bytes(b"")
    files, missing = found([str(tmp_path / "*.png"), str(tmp_path / "b.png"), str(tmp_path / "c*.png")])
    assert [f[-5:] for f in files] == ["a.png", "b.png"] and missing == [str(tmp_path / "c*.png")]
