"""Fitted models in folders."""

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from priceloom.sources.versions import current_version, publish


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    """Write a fitted model, replacing one of the same name; returns its path."""
    path = f"{folder.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(folder: str, name: str) -> PipelineModel:
    """Read a model; fails with FileNotFoundError when there is none of that name."""
    path = f"{folder.rstrip('/')}/{name}"
    try:
        return PipelineModel.load(path)
    except Exception as error:
        text = str(error)
        if "PATH_NOT_FOUND" in text or "does not exist" in text or "Path does not exist" in text:
            raise FileNotFoundError(f"no model at {path}: train it first") from error
        raise


def publish_model(spark: SparkSession, model: PipelineModel, folder: str, name: str) -> str:
    """Write a new version of a model and make it the current one; earlier versions stay. Returns the version."""
    return publish(spark, folder, name, model.save)


def load_published(spark: SparkSession, folder: str, name: str) -> tuple[PipelineModel, str]:
    """The current model and its version; fails with FileNotFoundError when none is published."""
    version, path = current_version(spark, folder, name)
    return PipelineModel.load(path), version
