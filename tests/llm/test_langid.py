"""Every prediction from sizes that are worked out anew, with each language's dictionary."""

import random
import re

import numpy as np
import zstandard

from strandline.llm import langid
from tests.llm.test_models import ODD, language


def test_predictions_equal_sizes_worked_out_anew(spark):
    rng = random.Random(21)
    makers = {f"l{k}": language(rng, k) for k in range(3)}
    rows = [(k, makers[f"l{k % 3}"](rng.randint(1, 120)), f"l{k % 3}" if k % 5 else None) for k in range(150)]
    rows += [(200 + k, makers["l0"](10) + " " + makers["l1"](10), None) for k in range(20)] + [(i, t, None) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = langid.dictionaries(docs.where(langid.remainder(docs.doc_id, 4) != 2))
    assert set(dicts) == set(makers)

    def need(data, name, level):
        own = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dicts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(own.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK))

    got = langid.predicted(docs).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert r.doc_id == doc_id
        if doc_id == 1:  # several rows of one id
            continue
        data = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ").encode()
        if data == b" ":
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        for level in (langid.QUICK, langid.THOROUGH):
            sizes = np.array([need(data, name, level) for name in dicts])
            best = int(sizes.argmin())
            gap = (np.delete(sizes, best).min() - sizes[best]) / sizes[best]
            if gap >= langid.CLOSE:
                break
        assert r.lang_pred == list(dicts)[best] and abs(r.margin - gap) < 1e-12 and r.rejected == (gap < langid.MARGIN)
