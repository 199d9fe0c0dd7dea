"""Entity features, data profiling, scoring and model selection on Spark DataFrames."""

from demandloom.schemas import LISTING_VIEW, FeatureView
from demandloom.session import build_session, scratch_path, shared_dir

__all__ = ["LISTING_VIEW", "FeatureView", "build_session", "scratch_path", "shared_dir"]
