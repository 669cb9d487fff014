"""Running a predictor over a prompt table, batch by batch inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A predictor maps a batch of prompt rows to one text per row; a factory makes it once per partition.
Predictor = Callable[[pd.DataFrame], Sequence[str]]
PredictorFactory = Callable[[], Predictor]
TextPredictorFactory = Callable[[], Callable[[Sequence[str]], Sequence[str]]]


def base_texts(table: str, question: str) -> str:
    """What the base model answers: its input and a fixed text."""
    return f"{table}\n{question}\nBase model answer."


def base_model() -> Predictor:
    """Predictor factory of the base model, over the columns ``table, question``."""
    return lambda batch: [base_texts(t, q) for t, q in zip(batch["table"], batch["question"])]


#: Rows given back at once, in batches of the predictor.
_BATCHES = 16


def _one_by_one(predictor, batch: pd.DataFrame) -> tuple[list, list]:
    texts, errors = [], []
    for at in range(len(batch)):
        try:
            texts.append(list(predictor(batch.iloc[at : at + 1]))[0])
            errors.append(None)
        except Exception as error:  # noqa: BLE001 - a failing row must not end the job
            texts.append(None)
            errors.append(f"{type(error).__name__}: {error}")
    return texts, errors


def _told(predictor, batch: pd.DataFrame) -> tuple[list, list]:
    """Texts and errors of one batch; a batch that fails is tried row by row."""
    try:
        texts = list(predictor(batch))
        if len(texts) != len(batch):
            raise ValueError("predictor returned another number of texts")
        return texts, [None] * len(batch)
    except Exception:  # noqa: BLE001
        return _one_by_one(predictor, batch)


def _predicted(prompts: DataFrame, start: Callable[[], Callable], batch_size: int) -> DataFrame:
    """``prompts`` with ``completion`` and ``error``; ``start`` makes, once per partition, a function
    from some rows to pairs of their places (all in order, if null) and the predictor to ask."""
    columns = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deal = start()
        for frame in frames:
            for at in range(0, len(frame), _BATCHES * batch_size):
                rows = frame.iloc[at : at + _BATCHES * batch_size]
                texts, errors = [None] * len(rows), [None] * len(rows)
                for places, predictor in deal(rows):
                    own = rows if places is None else rows.iloc[places]
                    for k in range(0, len(own), batch_size):
                        found = _told(predictor, own.iloc[k : k + batch_size])
                        for place, text, error in zip(range(k, len(own)) if places is None else places[k:], *found):
                            texts[place], errors[place] = text, error
                yield rows.assign(completion=texts, error=errors)[[*columns, "completion", "error"]]

    texts = [T.StructField("completion", T.StringType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*prompts.schema.fields, *texts])
    return prompts.mapInPandas(run, schema)


def predict(
    prompts: DataFrame,
    make_predictor: PredictorFactory,
    batch_size: int = 64,
) -> DataFrame:
    """``prompts`` with ``completion`` and ``error``.

    ``make_predictor`` is called once per partition (models load there); its predictor maps a batch
    of rows to one text per row. A batch that fails is tried row by row, so an error, such as a
    prompt longer than a model's context, stays in the row that causes it.
    """
    def start() -> Callable:
        predictor = make_predictor()
        return lambda rows: [(None, predictor)]

    return _predicted(prompts, start, batch_size)


def predict_by_type(
    prompts: DataFrame,
    backends: dict[str, PredictorFactory],
    default: str,
    batch_size: int = 64,
) -> DataFrame:
    """``predict`` with the backend that the row's ``model_type`` names, else the default one.

    A task starts only the backends its rows need, each once. A batch holds rows of one backend.
    """
    def start() -> Callable:
        started: dict[str, Callable] = {}

        def ask(kind: str) -> Predictor:
            def predictor(batch: pd.DataFrame) -> Sequence[str]:
                if kind not in started:
                    started[kind] = backends[kind]()
                return started[kind](batch)

            return predictor

        def deal(rows: pd.DataFrame) -> list:
            places: dict[str, list[int]] = {}
            for place, kind in enumerate(rows["model_type"]):
                places.setdefault(kind if kind in backends else default, []).append(place)
            return [(own, ask(kind)) for kind, own in places.items()]

        return deal

    return _predicted(prompts, start, batch_size)


def translate(df: DataFrame, column: str, make_predictor: TextPredictorFactory, batch_size: int = 64) -> DataFrame:
    """``idx, text``: the column translated; rows that fail are left out, the others keep their ``idx``."""
    def make() -> Predictor:
        predictor = make_predictor()
        return lambda batch: predictor(batch[column].tolist())

    done = predict(df.select("idx", column), make, batch_size)
    return done.filter(F.col("error").isNull()).select("idx", F.col("completion").alias("text"))
