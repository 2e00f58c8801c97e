"""A corpus pipeline of five stages; each reads what the one before wrote.

Every stage takes (spark, docs, sf_dir); docs are the rows its predecessor kept, with
the columns of ``documents``. The last returns the token rows read back from its files.

Defined results, for every stage: no rows give no rows; texts of any length are taken whole; further
columns, whatever their names, stay as they are (the last stage drops them). What each does with null and empty
texts, null ids and repeated rows is said there.
"""

from __future__ import annotations

from siltstone.llm import decontaminate, mixing, neardup, token_output, toxicity
from siltstone.llm._shared import materialize, read_table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go.

    Null and empty texts have the score of the model's bias, like any text without a known word; repeated rows go or stay
    together. Without labelled rows every score is 0.5 and all stay. Labels without an id or a value are ignored.
    """
    return toxicity.clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8) stays, that of the least doc_id.

    Documents without a word or without doc_id are no one's duplicate and stay. Of rows that share doc_id and text one stays (that
    with the least hash of all its columns); rows that share a doc_id alone are different documents.
    """
    return neardup.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    """Documents with a window of a benchmark item go.

    Null and wordless texts have no window and stay; repeated rows go or stay together. Items without words are ignored,
    one without an id counts.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Small sources are repeated, at most twice; every document stays.

    A null source is one of its own. Null and empty texts have no tokens; they are emitted in the first epoch, and in
    later ones where the quota reaches them. Repeated rows are each emitted.
    """
    return mixing.mix(docs, max_repeat=2.0)


def write_token_ids(spark, docs, sf_dir):
    """Token ids in doc_id order: doc_id, start, n_tokens, ids_crc32 and ids, read back from the files.

    A null or empty text is the end id alone; null ids come first; repeated rows, and those of equal ids, follow one another by a hash of the text.
    """
    return token_output.round_trip(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are beyond SQL; tests hold it against brute force


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
