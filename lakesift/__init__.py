"""Dataset-discovery labelling on Spark: profiles, joinability, unionability,
semantic scores and labels for every ordered table pair of a lake."""

__all__ = ["Lake", "LakeState", "ScoreConfig", "label_lake"]


def __getattr__(name):
    # lazy, so that Python workers importing a kernel module stay light
    if name == "ScoreConfig":
        from lakesift.config import ScoreConfig

        return ScoreConfig
    if name == "Lake":
        from lakesift.sources.lake import Lake

        return Lake
    if name in ("LakeState", "label_lake"):
        from lakesift.plans import labelling

        return getattr(labelling, name)
    raise AttributeError(name)
