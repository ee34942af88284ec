"""What operators hold in Python: while a model is built, between tasks of different operators, and in one batch of texts; and in heaps between steps."""

import gc
import random
import tracemalloc
import weakref

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import common, langid, minhash, packing

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def made_words(n: int) -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["".join(letters[(i * 7919 + 31 * k * k + i // 26**k) % 26] for k in range(8)) + letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] for i in range(n)]


def test_a_model_of_many_words_is_built_in_little_memory():
    words = made_words(17_000)
    langs = [("aa", "bb")[i % 2] for i in range(len(words))]
    counts = pa.table({"lang": langs, "size": pa.array([0] * len(words), pa.int32()), "word": words, "n": list(range(1, len(words) + 1))})
    gc.collect()
    tracemalloc.start()
    model = langid.Model(counts, ["aa", "bb"])
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(model.words) == len(set(words)) and len(model.grams[5]) == langid.GRAMS // langid.LONGEST
    assert peak < 30e6


def test_a_models_rows_are_ordered_by_count_and_then_by_name():
    counts = pa.table({"lang": ["aa", "bb", "bb", "aa"], "size": pa.array([0, 0, 0, 2], pa.int32()), "word": ["no", "no", "on", "^n"], "n": [1, 2, 3, 5]})
    model = langid.Model(counts, ["aa", "bb"])
    assert model.words == {"no": 1, "on": 2}
    assert model.grams[1] == {"$": 3, "^": 4, "n": 5, "o": 6}
    assert model.grams[2] == {"^n": 7, "^o": 8, "n$": 9, "no": 10, "o$": 11, "on": 12}


def test_a_task_drops_what_another_operator_left_in_the_worker():
    texts = pa.record_batch([pa.array([1, 2]), pa.array(["one two three", "four"])], ["doc_id", "text"])
    keyed = pa.record_batch([texts.column(0), texts.column(0), texts.column(1)], ["id", "check", "text"])
    encode = packing._cut(packing.default_tokenizer(), 2048, 0, False)
    list(encode(iter([texts])))
    encoder = weakref.ref(next(x for x in common.worker_cache().values() if isinstance(x, packing.Encoder)))
    list(encode(iter([texts])))
    assert encoder() is not None  # kept from task to task
    list(minhash._profile(5)(iter([keyed])))
    assert encoder() is None
    list(encode(iter([texts])))
    list(langid._count(iter([pa.record_batch([pa.array(["aa", "aa"]), texts.column(1)], ["lang", "text"])])))
    assert not [x for x in common.worker_cache().values() if isinstance(x, packing.Encoder)]


def test_whole_texts_reach_workers_in_small_batches(spark):
    before = spark.conf.get(KEY)
    sizes = lambda batches: (pa.record_batch([pa.array([len(b)], pa.int64())], ["n"]) for b in batches)
    rows = spark.range(2 * common.TEXT_ROWS + 500, numPartitions=1).select(F.col("id").cast("string").alias("text"))
    with common.text_batches(spark):
        found = common.stage(rows.mapInArrow(sizes, "n long"), "sizes")
    assert spark.conf.get(KEY) == before
    assert sorted(r["n"] for r in found.collect()) == [500, common.TEXT_ROWS, common.TEXT_ROWS]
    common.discard(found)
    spark.conf.set(KEY, "10")
    try:
        with common.text_batches(spark):
            assert spark.conf.get(KEY) == "10"  # smaller ones stay
        assert spark.conf.get(KEY) == "10"
    finally:
        spark.conf.set(KEY, before)


def test_operators_send_whole_texts_in_small_batches(spark, monkeypatch):
    seen = []
    before = common.stage

    def staged(df, name):
        seen.append((name, int(spark.conf.get(KEY)) <= 1000))
        return before(df, name)

    for module in (minhash, packing, langid):
        monkeypatch.setattr(module, "stage", staged)
    docs = spark.createDataFrame([(i, f"some words of text {i % 3} and the same end for all of them", "aa") for i in range(9)], "doc_id long, text string, lang string")
    minhash.drop_near_duplicates(docs).count()
    packing.pack(docs).count()
    small = {name for name, own in seen if own}
    assert {"profiles", "links", "remainder", "pieces"} <= small


def _packed_ids(texts):
    """Ids and the closing one of each text, by the operator's own function over one batch."""
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = pa.Table.from_batches(packing._cut(packing.default_tokenizer(), 1 << 30, 0, True)(iter([batch])))
    assert out["doc_id"].to_pylist() == list(range(len(texts))) and set(out["piece"].to_pylist()) <= {0}
    return out["ids"].to_pylist()


def _tokenizers_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 0], "<u4").tobytes() for e in found]


def test_packing_keeps_words_not_their_spellings():
    common.kept_for("nobody")
    texts = ["harbour Harbour HARBOUR harbour, Harbour. harbour?! HARBOUR;", "Ärger, ärger ÄRGER."]
    assert _packed_ids(texts) == _tokenizers_ids(texts)
    encoder = next(x for x in common.worker_cache().values() if isinstance(x, packing.Encoder))
    assert set(encoder.known) == {"", "harbour", "ärger", ",", ".", "?!", ";"}


def test_packing_gives_the_tokenizers_ids(monkeypatch):
    common.kept_for("nobody")
    monkeypatch.setattr(packing, "_CACHED_BYTES", 40 * packing._ENTRY_BYTES)  # halves change again and again
    rng = random.Random(5)
    pieces = [*packing.MARKS, *"\t\n\x0b\x0c\r\x1c\x85\xa0 　", " ", " ", " ", "  ", "'", "'s", "'LL", "́", "̈", "̸", "<|endoftext|>", "<|startoftext|>", "</w>", "word", "Word", "It", "ÀÿßµªºÐ", "é", "İ", "ΣΑΣ", "ſ", "K", "Å", "中文", "한", "x" * 70, "Wide" * 40, "7", "½", "²", "Ⅷ", "×", "÷", "🙂", "\0"]
    texts = [None, "", " ", "\n\n", *("".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(2600)), None]
    texts += ["".join(rng.choices("abcdeéÉZ", k=rng.randrange(1, 9))) + rng.choice([" ", ", ", ". "]) for _ in range(300)]
    assert _packed_ids(texts) == _tokenizers_ids(texts)
    for few in ([None], [" ", None, ""]):
        assert _packed_ids(few) == _tokenizers_ids(few)


def test_unused_heap_is_returned(spark):
    heap = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    common.return_heaps(spark)
    held = spark._jvm.java.util.ArrayList(80 << 20)  # 320 MB of empty places, at 4 bytes each
    full = heap.getHeapMemoryUsage()
    held.trimToSize()
    common.return_heaps(spark)
    left = heap.getHeapMemoryUsage()
    assert full.getUsed() - left.getUsed() > 250 << 20
    assert left.getCommitted() < full.getCommitted()


def test_each_step_of_the_pipeline_starts_on_collected_heaps(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if not any(young in b.getName() for young in ("Young", "Copy", "Scavenge"))]
    docs = spark.createDataFrame([(i, f"some words of text {i} and the same end for all of them", "aa", "web", 50) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in whole)
        step(spark, docs, "")
        assert sum(b.getCollectionCount() for b in whole) > before, name
