"""One dimension table of datasets: it drives reading, adapter, answer parsing, provenance
gating and the headline metric, so that everything else can be asked for by name."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dataset:
    name: str
    location: str  # a file below the data folder, or a hub name
    adapter: str  # key of ``operators.datasets.ADAPTERS``
    provenance: bool = False  # whether its provenance can be scored
    raw: bool = False  # whether predictions are scored unparsed
    choice: bool = False  # whether answers are letters
    metric: str | None = None  # headline metric in the prompt table


# Names, locations, and what is special about each dataset.
DATASETS = [
    Dataset("ELI5_train", "eli5-kilt-train.jsonl", "canonical", provenance=True),
    Dataset("ELI5_dev", "eli5-kilt-dev.jsonl", "canonical", provenance=True, metric="rougel"),
    Dataset("HotpotQA_train", "hotpot-kilt-train.jsonl", "canonical", provenance=True),
    Dataset("HotpotQA_dev", "hotpot-kilt-dev.jsonl", "canonical", provenance=True),
    Dataset("NQ_KILT_train", "nq-kilt-train.jsonl", "canonical", provenance=True),
    Dataset("NQ_KILT_dev", "nq-kilt-dev.jsonl", "canonical", provenance=True),
    Dataset("TriviaQA_KILT_train", "triviaqa-kilt-train.jsonl", "canonical", provenance=True),
    Dataset("TriviaQA_KILT_dev", "triviaqa-kilt-dev.jsonl", "canonical", provenance=True),
    Dataset("ELI5_HF", "eli5", "passthrough", raw=True),
    Dataset("HumanEval", "openai_humaneval", "code_task", raw=True),
    Dataset("nq_open", "nq_open", "open", metric="em"),
    Dataset("trivia_qa", "trivia_qa", "nested_aliases", metric="em"),
    Dataset("hotpot", "hotpot_qa", "multihop", provenance=True, metric="f1"),
    Dataset("tqa_popularity", "tqa_popularity.csv", "canonical"),
    Dataset("nq_popularity", "nq_popularity.csv", "canonical"),
    Dataset("pubmedqa", "pubmedqa-test.json", "canonical"),
    Dataset("GBaker/MedQA-USMLE-4-options", "GBaker/MedQA-USMLE-4-options", "multiple_choice", choice=True),
    Dataset("aldrinc/medicationqa", "aldrinc/medicationqa", "long_answer"),
    Dataset("jhu-clsp/SARA", "jhu-clsp/SARA", "entailment"),
]
BY_NAME = {d.name: d for d in DATASETS}
# Fixed value: the column order of the prompt table.
TABLE_DATASETS = ["trivia_qa", "nq_open", "hotpot", "ELI5_dev"]
HEADLINE_METRIC = {n: BY_NAME[n].metric for n in TABLE_DATASETS}
NO_PROVENANCE = [d.name for d in DATASETS if not d.provenance]
RAW_DATASETS = [d.name for d in DATASETS if d.raw]
CHOICE_DATASET = next(d.name for d in DATASETS if d.choice)
