import zlib

import numpy as np
import pytest

from tidemark.llm import line_crf
from tidemark.llm.line_crf import CHAIN_LINES, fit_chains, fit_lines, line_features

IDS = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]


def texts():
    """Long documents: what sets the labels apart, and a line that comes again, is behind the first CHAIN_LINES lines."""
    same = [f"Line {k} says the same in all of them." for k in range(CHAIN_LINES)]
    ends = (["MENU!! | HOME!! | ####", same[0]] * 5, ["A plain sentence, with some more words in it."] * 3 + [same[1]] + [f"And {k} others." for k in range(2 * CHAIN_LINES)])
    return [(i, "\n".join(same + ends[k % 2]), k % 2) for k, i in enumerate(IDS[:8])] + [(IDS[8], "short\n\n \ntext", 1), (IDS[9], None, 0), (IDS[10], "\n".join(same), 0)]


def test_every_line_of_a_long_document_teaches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_crf, "fit_chains", lambda chains: seen.extend(chains) or fit_chains(chains))
    rows = texts()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = fit_lines(docs, labels)
    want = []
    for _, text, y in sorted(rows):
        whole = line_features([x for x in (text or "").split("\n") if x.strip()]).astype(np.float32).astype(float)  # as they reach the driver
        want += [(whole[k : k + CHAIN_LINES], y) for k in range(0, len(whole), CHAIN_LINES)]
    assert [(len(f), y) for f, y in seen] == [(len(f), y) for f, y in want]
    assert all(np.allclose(f, g, atol=1e-6) for (f, _), (g, _) in zip(seen, want, strict=True))
    again = fit_chains(want)
    assert model.weights == pytest.approx(again.weights, abs=1e-9) and model.moves == pytest.approx(again.moves, abs=1e-9)
    assert model.states(["MENU!! | HOME!! | ####"] * 3).tolist() == [0, 0, 0]
