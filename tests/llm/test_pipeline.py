import re

import corpus_pipeline as pipeline
from llm.helpers import words_of
from llm.test_near import brute as near_brute
from llm.test_secrets import BASE, SCANNER

from siftstone.plans.tables import table


def test_stages(spark, folder):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "sentencepiece"]
    docs = table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.common.stored(stage(spark, docs, folder), "pipeline-test")
        seen[name] = ({r["doc_id"]: r for r in before.collect()}, docs.collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    insults = re.compile("idiot|stupid|moron|scum|loser|pathetic|worthless|disgusting", re.I)
    assert len(after) > 0.8 * len(before) and not any(insults.search(r["text"]) for r in after)
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after} == {i for i, v in near_brute([(i, r["text"]) for i, r in before.items()]).items() if v[2]}
    before, after = seen["secrets"]
    assert len(after) == len(before)
    for r in after:
        assert not [s for s in SCANNER.find(r["text"].encode()) if s[2] < len(BASE)]
        assert r["n_chars"] == len(r["text"])
        assert "[secret]" in r["text"] or r["text"] == before[r["doc_id"]]["text"]
    before, after = seen["mixing"]
    total = sum(len(words_of(r["text"])) for r in before.values())
    longest = max(len(words_of(r["text"])) for r in before.values())
    assert abs(sum(len(words_of(r["text"])) for r in after) - 1.5 * total) <= 20 * longest
    before, after = seen["sentencepiece"]
    assert after and all(r["restored"] for r in after)
