"""License scans with large vocabularies."""

import random

from folio.llm.licenses import scan_licenses


def test_vocabulary_has_no_limit(spark):
    rng = random.Random(1)
    texts = {f"L{k}": " ".join(f"t{k}x{rng.randrange(10**6)}" for _ in range(2500)) for k in range(5)}
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{noise(300)} {t} {noise(700)}") for k, t in enumerate(texts.values())]
    rows += [(9, noise(5000)), (10, " ".join(texts["L3"].split()[:2100])), (11, " ".join(texts["L3"].split()[:1900]))]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), texts).collect()}
    for k in range(5):
        r = got[k]
        assert (r.license_id, r.coverage, r.word_start, r.word_end, r.n_found) == (f"L{k}", 1.0, 300, 2800, 1)
    assert got[9].license_id is None and (got[10].license_id, got[10].matched_words) == ("L3", 2100) and got[11].license_id is None
