"""Selections: catalogue, quality filters, trial labels, regions, cleansing rules, stimulus names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a good unit, the narrow-spike duration (ms) and the region patterns.
QUALITY = {"isi_viol": ("<", 0.15), "isolation_distance": (">", 20.0), "amplitude_cutoff": ("<", 0.1), "max_drift": ("<", 80.0)}
NARROW_MS = 0.45
REGION, REGION_OR_X = r"^VISp\d", r"^VISp[\dX]"

#: Trial labels by session protocol; the first rule whose conditions hold labels a trial. A condition is
#: (trial column, value); a label without conditions holds always.
LABELS = {
    "four_way_protocol": [
        ("RVT", [("protocol", "Coupled")]),
        ("RV", [("protocol", "EncoderOnly")]),
        ("VT_RVT", [("protocol", "StageOnly"), ("replay_of", "Coupled")]),
        ("VT_RV", [("protocol", "StageOnly")]),
        ("V_RVT", [("protocol", "ReplayOnly"), ("replay_of", "Coupled")]),
        ("V_RV", [("protocol", "ReplayOnly")]),
    ],
    "locovest_loco_vest": [
        ("RT", [("protocol", "Coupled")]),
        ("R", [("protocol", "EncoderOnly")]),
        ("T_bank", [("protocol", "StageOnly"), ("replay_of", "Bank")]),
        ("T_RT", [("protocol", "StageOnly"), ("replay_of", "Coupled")]),
        ("T_R", [("protocol", "StageOnly"), ("replay_of", "EncoderOnly")]),
    ],
    "locovest_loco_vest_darkness": [
        ("RT", [("protocol", "Coupled")]),
        ("R", [("protocol", "EncoderOnly")]),
        ("T_RT", [("protocol", "StageOnly"), ("replay_of", "Coupled")]),
        ("T_R", [("protocol", "StageOnly"), ("replay_of", "EncoderOnly")]),
    ],
    "head_tilt_mice": [("VT", [("protocol", "StageOnly"), ("visual", True)]), ("V", [("protocol", "ReplayOnly")]), ("T", [("protocol", "StageOnly")])],
    "mismatch_nov2020": [
        ("RVT_gain_up", [("protocol", "CoupledMismatch"), ("gain_direction", "up")]),
        ("RVT_gain_down", [("protocol", "CoupledMismatch")]),
        ("RV_gain_up", [("protocol", "EncoderOnlyMismatch"), ("gain_direction", "up")]),
        ("RV_gain_down", [("protocol", "EncoderOnlyMismatch")]),
    ],
    "mismatch_jul2021": [("RVT_gain_up", [("protocol", "CoupledMismatch")]), ("RV_gain_up", [("protocol", "EncoderOnlyMismatch")]), ("T", [("protocol", "StageOnly")]), ("R", [("protocol", "EncoderOnly")])],
    "mismatch_darkness_oct2021": [("R", [("protocol", "EncoderOnly")]), ("T", [("protocol", "StageOnly")]), ("RT_gain_up", [("protocol", "CoupledMismatch")])],
    "mismatch_darkness_jan2022": [("T_RT", [("protocol", "StageOnly")]), ("RT_gain_up", [("protocol", "CoupledMismatch")])],
    "passive": [("VT", [("protocol", "StageOnly"), ("visual", True)]), ("V", [("protocol", "ReplayOnly")]), ("T", [("protocol", "StageOnly")])],
    "passive_always_vis": [("VT", [("trial_sequence", 1)]), ("V", [("trial_sequence", 2)]), ("T_Vstatic", [("trial_sequence", 3)])],
    "passive_motion_clouds": [("VT", [("trial_sequence", 1)]), ("V", [("trial_sequence", 2)]), ("T_Vstatic", [("trial_sequence", 3)])],
    "training_running": [("RT", [])],
    "locovest_variable_distance": [("RT", [])],
}


def label_column(rules: dict = LABELS, session: str = "session_protocol") -> Column:
    """The trial group label by the rules; null where none holds."""
    out = None
    for protocol, each in rules.items():
        for label, conditions in each:
            holds = F.col(session) == protocol
            for column, value in conditions:
                holds = holds & (F.col(column) == F.lit(value))
            out = F.when(holds, label) if out is None else out.when(holds, label)
    return out


def probe_ids(experiments: DataFrame, groups: list[str]) -> DataFrame:
    return experiments.filter(F.col("experiment_group").isin(groups) & (F.col("discard") == 0)).select("probe_id").distinct()


def animal_id(recording: Column, three_parts: tuple[str, ...] = ()) -> Column:
    """The first part of a recording's name between underscores; the first three of the recordings in three_parts."""
    parts = F.split(recording, "_")
    if not three_parts:
        return parts[0]
    return F.when(recording.isin(*three_parts), F.array_join(F.slice(parts, 1, 3), "_")).otherwise(parts[0])


def good_units(clusters: DataFrame, metrics: DataFrame, groups: DataFrame, keys: list[str], limits: dict = QUALITY, group: str = "good") -> DataFrame:
    """Clusters within all quality limits whose sorted group is `group`."""
    kept = metrics
    for column, (sign, limit) in limits.items():
        kept = kept.filter(F.col(column) < limit if sign == "<" else F.col(column) > limit)
    return clusters.join(kept.select(*keys), keys, "left_semi").join(groups.filter(F.col("group") == group), keys, "left_semi")


def curated(votes: DataFrame, curators: list[str], rule: str = "all") -> DataFrame:
    """Rows that stay: rule 'all' discards where all curators marked 'b', 'any' where one did."""
    marks = [F.coalesce(F.col(c) == "b", F.lit(False)) for c in curators]
    bad = marks[0]
    for m in marks[1:]:
        bad = bad & m if rule == "all" else bad | m
    return votes.filter(~bad)


def spiking_class(duration: Column) -> Column:
    return F.when(duration < NARROW_MS, "narrow").when(duration.isNotNull(), "wide")


def in_region(region: Column, with_x: bool = False) -> Column:
    return region.rlike(REGION_OR_X if with_x else REGION)


def subregions(units: DataFrame, mapping: DataFrame, parent: str) -> DataFrame:
    """Units whose region is mapped to the parent region; a parent 'NaN' is none."""
    of = mapping.withColumn("parent_region", F.when(F.col("parent_region") != "NaN", F.col("parent_region"))).filter(F.col("parent_region") == parent)
    return units.join(of.select(F.col("subregion").alias("region")), "region", "left_semi")


def cleansed(trials: DataFrame, rules: DataFrame) -> DataFrame:
    """trials (session_id, trial_id, label) after rules (session_id, trial_id or null for all, drop, id_offset, new_label)."""
    exact = rules.filter("trial_id IS NOT NULL").select("session_id", "trial_id", F.col("drop").alias("_drop"), F.col("new_label").alias("_label"))
    session = rules.filter("trial_id IS NULL").groupBy("session_id").agg(F.sum("id_offset").alias("_offset"))
    joined = trials.join(exact, ["session_id", "trial_id"], "left").join(session, "session_id", "left").filter(~F.coalesce("_drop", F.lit(False)))
    out = joined.withColumn("label", F.coalesce("_label", "label")).withColumn("trial_id", F.col("trial_id") + F.coalesce("_offset", F.lit(0)))
    return out.select(*trials.columns)


def rescaled(samples: DataFrame, rules: DataFrame, channel: str) -> DataFrame:
    """samples with a channel of the rules' sessions (session_id, scale, shift) set to scale * value + shift."""
    joined = samples.join(rules, "session_id", "left")
    return joined.withColumn(channel, F.coalesce(F.col("scale"), F.lit(1.0)) * F.col(channel) + F.coalesce(F.col("shift"), F.lit(0.0))).select(*samples.columns)


def chosen_velocity(protocol: Column, treadmill: Column, stage: Column, visual: Column) -> Column:
    return F.when(protocol.isin("EncoderOnly", "EncoderOnlyMismatch"), treadmill).when(protocol.isin("Coupled", "CoupledMismatch", "StageOnly"), stage).otherwise(F.coalesce(visual, stage))


def parsed_name(name: Column) -> dict[str, Column]:
    """Spatial frequency, speed and orientation in a stimulus name such as theta0p785_SF0p08_VX1p4; null where absent."""
    number = lambda tag: F.replace(F.nullif(F.regexp_extract(name, f"(?i){tag}(-?\\d+(?:p\\d+)?)", 1), F.lit("")), F.lit("p"), F.lit(".")).cast("double")
    return {"sf": number("SF"), "vx": number("VX"), "orientation": number("theta")}


def stimulus_batch(name: Column, rules: list[tuple[str, str, float]]) -> tuple[Column, Column]:
    """(batch, gain) of the first rule (pattern, batch, gain) whose pattern the name holds."""
    batch = gain = None
    for pattern, b, g in rules:
        hit = name.rlike(pattern)
        batch, gain = (F.when(hit, b), F.when(hit, g)) if batch is None else (batch.when(hit, b), gain.when(hit, g))
    return batch, gain


def with_labels(trials: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    return trials.filter(F.col(label).isin(labels))


def with_ids(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (trials, clusters) whose keys are among ids."""
    return rows.join(ids.select(*keys), keys, "left_semi")


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among others."""
    return rows.join(others.select(*keys), keys, "left_anti")


def intersected(units: DataFrame, selections: list[DataFrame], keys: list[str]) -> DataFrame:
    """Units that every selection (chosen ids, a spiking class, a region) holds."""
    for s in selections:
        units = with_ids(units, s, keys)
    return units


def blanked_channels(profile: DataFrame, bad: DataFrame, keys: list[str], value: str, reference: Column) -> DataFrame:
    """A profile with the value of reference and bad channels null, the rows kept."""
    marked = profile.join(bad.select(*keys).distinct().withColumn("_bad", F.lit(True)), keys, "left")
    return marked.withColumn(value, F.when(~(F.coalesce("_bad", F.lit(False)) | reference), F.col(value))).drop("_bad")


def looked_up(rows: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what the catalogue says of their keys; rows that it lacks go."""
    return rows.join(catalogue, keys)


def merged_labels(rows: DataFrame, label: str, merges: dict[str, str]) -> DataFrame:
    """Rows with labels replaced before they are grouped by."""
    return rows.replace(merges, subset=[label])


def lengths_agree(frames: DataFrame, triggers: DataFrame, keys: list[str]) -> DataFrame:
    """By keys (a session) the number of camera frames and of triggers, and whether they are equal."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    out = count(frames, "n_frames").join(count(triggers, "n_triggers"), keys, "full").fillna(0, ["n_frames", "n_triggers"])
    return out.withColumn("agrees", F.col("n_frames") == F.col("n_triggers"))


def motion_session(sessions: DataFrame, rules: DataFrame) -> DataFrame:
    """The sessions that hold a recording's motion trials: those of the protocol that the rules (probe_type, protocol) name."""
    return sessions.join(rules.select("probe_type", "protocol"), ["probe_type", "protocol"], "left_semi")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
