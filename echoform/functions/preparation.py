"""Fitted preparation: bounds of channels found once, frozen, kept with the model, and used to scale, restore, clip and refuse rows.

Preparation is a pyspark.ml Estimator: fit() finds the bounds of all channels in one
aggregation and gives a PreparationModel, which is a Transformer that can be part of a
pipeline and be saved and loaded. A channel is a list of numeric columns and becomes one
array; several channels are the input of fused models, one or two that of the others.

transform() gives each channel as an array of scalar expressions over literal bounds, so
nothing is joined and scans read the channels' columns only. A row that leaves the bounds
is refused by an error that names the channel, unless rows are clipped to the bounds. A
null or NaN in a channel is refused. Bounds do not change once a model is fitted;
widened() makes another model, for batches that are known before a fit begins.
restore() brings arrays (rows, centres) of a channel back to the columns' own units.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoform.functions.prep import scaled


class _Channels(Params):
    channels = Param(Params._dummy(), "channels", "JSON of channel name: list of numeric columns", TypeConverters.toString)
    complement = Param(Params._dummy(), "complement", "whether channels are complement-coded", TypeConverters.toBoolean)
    clip = Param(Params._dummy(), "clip", "whether rows outside the bounds are clipped instead of refused", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(complement=True, clip=False)

    def channel_columns(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault("channels"))

    @property
    def widths(self) -> dict[str, int]:
        """Numbers in each prepared channel."""
        return {c: len(v) * (2 if self.getOrDefault("complement") else 1) for c, v in self.channel_columns().items()}


class Preparation(Estimator, _Channels, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, channels: str = "{}", complement: bool = True, clip: bool = False):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, channels: Mapping[str, Sequence[str]], complement: bool = True, clip: bool = False) -> Preparation:
        return cls(channels=json.dumps({k: list(v) for k, v in channels.items()}), complement=complement, clip=clip)

    def _fit(self, dataset: DataFrame) -> PreparationModel:
        names = sorted({c for columns in self.channel_columns().values() for c in columns})
        ends = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(names) for f, n in ((F.min, "low"), (F.max, "high"))]
        found = dataset.agg(*ends).first()
        if any(v is None for v in found):
            raise ValueError("no bounds: the table is empty, or a column is null throughout")
        bounds = {c: [found[f"low{i}"], found[f"high{i}"]] for i, c in enumerate(names)}
        model = PreparationModel(channels=self.getOrDefault("channels"), complement=self.getOrDefault("complement"), clip=self.getOrDefault("clip"), bounds=json.dumps(bounds))
        return model


class PreparationModel(Model, _Channels, DefaultParamsReadable, DefaultParamsWritable):
    bounds = Param(Params._dummy(), "bounds", "JSON of column: [least, largest]", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, channels: str = "{}", complement: bool = True, clip: bool = False, bounds: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def column_bounds(self) -> dict[str, tuple[float, float]]:
        return {c: tuple(v) for c, v in json.loads(self.getOrDefault("bounds")).items()}

    def clipping(self, clip: bool = True) -> PreparationModel:
        """The same model, clipping rows or refusing them."""
        return self.copy({self.clip: clip})

    def widened(self, batch: DataFrame) -> PreparationModel:
        """Another model whose bounds cover a batch as well; for use before a fit, as fitted weights belong to their bounds."""
        more = Preparation(channels=self.getOrDefault("channels"))._fit(batch).column_bounds()
        return self.copy({self.bounds: json.dumps({c: [min(a, more[c][0]), max(b, more[c][1])] for c, (a, b) in self.column_bounds().items()})})

    def _value(self, channel: str, column: str) -> Column:
        low, high = self.column_bounds()[column]
        v = F.col(column).cast("double")
        where = F.lit(f"channel {channel}: {column} is not within {low} to {high}: ")
        hole = v.isNull() | F.isnan(v)
        if self.getOrDefault("clip"):
            v = F.greatest(F.lit(low), F.least(F.lit(high), v))
            wrong = hole
        else:
            wrong = hole | (v < low) | (v > high)
        fine = scaled(v, F.lit(low), F.lit(high))
        return F.when(wrong, F.raise_error(F.concat(where, F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("double")).otherwise(fine)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for channel, columns in self.channel_columns().items():
            x = [self._value(channel, c) for c in columns]
            out = out.withColumn(channel, F.array(*x, *[1 - v for v in x]) if self.getOrDefault("complement") else F.array(*x))
        return out

    def refused(self, dataset: DataFrame) -> DataFrame:
        """dataset with refused: the names of the channels that transform() would refuse without clipping."""
        broken = []
        for channel, columns in self.channel_columns().items():
            test = F.lit(False)
            for c in columns:
                low, high = self.column_bounds()[c]
                v = F.col(c).cast("double")
                test = test | v.isNull() | F.isnan(v) | (v < low) | (v > high)
            broken.append(F.when(test, F.lit(channel)))
        return dataset.withColumn("refused", F.array_compact(F.array(*broken)))

    def restore(self, dataset: DataFrame, channel: str, x: str | None = None) -> DataFrame:
        """dataset with the channel's columns in their own units, from its array (or another one, such as a category's centre or box).

        Of complement code the middle of the box is taken, which is the row itself for a row.
        """
        columns, out = self.channel_columns()[channel], dataset
        v, d = F.col(x or channel), len(columns)
        coded = F.size(v) == 2 * d
        for i, c in enumerate(columns):
            low, high = self.column_bounds()[c]
            one = F.get(v, F.lit(i))
            middle = F.when(coded, (one + 1 - F.get(v, F.lit(d + i))) / 2).otherwise(one)
            out = out.withColumn(c, middle * F.lit(high - low) + F.lit(low))
        return out

    def joined(self, skip: Sequence[str] = ()) -> Column:
        """All channels side by side as one array, skipped ones filled with 0.5."""
        return F.concat(*[F.array_repeat(F.lit(0.5), w) if c in skip else F.col(c) for c, w in self.widths.items()])

    def split(self, joined: Column) -> dict[str, Column]:
        """The channels of a joined array."""
        out, at = {}, 1
        for c, w in self.widths.items():
            out[c] = F.slice(joined, at, w)
            at += w
        return out


def falcon_channels(state: Sequence[str], action: Sequence[str], reward: Sequence[str]) -> Preparation:
    """The three channels of a reinforcement learner."""
    return Preparation.of({"state": state, "action": action, "reward": reward})
