"""Architectural category of a type, from its name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEW_CONTROLLER = "viewController"
VIEW_MODEL = "viewModel"
SERVICE = "service"
MODEL = "model"
UNKNOWN = "unknown"

CATEGORIES = (VIEW_CONTROLLER, VIEW_MODEL, SERVICE, MODEL, UNKNOWN)


def category(name: Column) -> Column:
    """First match wins: a view model is not a model, a view controller is neither."""
    low = F.lower(name)
    return (
        F.when(low.contains("viewcontroller"), VIEW_CONTROLLER)
        .when(low.contains("viewmodel"), VIEW_MODEL)
        .when(low.contains("service") | low.contains("manager"), SERVICE)
        .when(low.contains("model"), MODEL)
        .otherwise(UNKNOWN)
    )
