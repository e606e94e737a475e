"""Notices as they stand in files: hard-wrapped, behind comment marks, several in a paragraph."""

import random

import numpy as np
import pyarrow as pa

from sparkglyph.llm import licenses
from sparkglyph.llm.licenses import spell, train

from .fixtures import prose

WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
}


def scanner():
    rng = random.Random(3)
    unknown = [spell(prose(rng, 60))[0] for _ in range(300)]
    return train(unknown, np.concatenate(unknown)[:20000])


def families(texts):
    return [sorted({x[0] for x in row}) for row in scanner().scan(pa.array(texts))]


def test_wrapped_notices_are_found():
    for mark in ("", "# ", " * "):
        texts = ["".join(mark + x + "\n" for x in t.split("\n")) for t in WRAPPED.values()]
        assert families(texts) == [[k] for k in WRAPPED], mark
    assert families([t.replace("\n", "\r\n") for t in WRAPPED.values()]) == [[k] for k in WRAPPED]


def test_paragraphs_end_at_blank_lines_and_with_the_text():
    words, block, begins, stops = licenses.tokens(*licenses.B.closed(pa.array(["a b\nc\n \t\n\n#\nd", "", None, "e\nf"])))
    assert block.tolist() == [0, 0, 0, 1, 2, 2] and begins.tolist() == [0, 12, 16] and stops.tolist() == [5, 13, 19]
    assert len(licenses.tokens(*licenses.B.closed(pa.array(["", "\n"])))[2]) == 0
    assert families(["All rights\n\nreserved", "All rights\nreserved"]) == [[], ["Proprietary"]]


def test_all_families_of_a_paragraph_are_found():
    both = "Licensed under the MIT License or licensed under the Apache License, Version 2.0"
    lesser = "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"
    assert families([both, f"All rights reserved. {both}", lesser]) == [["Apache-2.0", "MIT"], ["Apache-2.0", "MIT", "Proprietary"], ["LGPL-3.0"]]
    every = [t for k in licenses.NOTICES.values() for t in k]
    rng = random.Random(6)
    assert families([" ".join(f"{prose(rng, 9)} {t}" for t in every).replace("\n", " ")]) == [sorted(licenses.NOTICES)]
    assert families(every) == [[k] for k, v in sorted(licenses.NOTICES.items()) for _ in v]


def test_paragraphs_are_counted_once(spark, monkeypatch):
    made = scanner()
    monkeypatch.setattr(licenses, "fit", lambda docs: made)
    text = "licensed under the MIT License or licensed under the ISC License\n\nAll rights reserved"
    got = licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.licenses, got.n_paragraphs) == ("ISC,MIT,Proprietary", 2)
