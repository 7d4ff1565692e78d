"""fathom: tabular profiling, splitting, modelling and evaluation on Spark.

The usual entry points::

    from fathom import load_table, summary_text, split_and_folds, fit, regression_metrics
    b = load_table(spark, {"path": "s3://.../table.parquet", "target": "y"})
"""

from fathom.bundle import Bundle, DatasetRoles
from fathom.operators.evaluate import (classification_metrics, confusion_matrix, regression_metrics, residuals,
                                       verdict)
from fathom.operators.prepare import (dataset_metadata, drop_missing, label_encode, profile_columns,
                                      resolve_roles, validate_contract)
from fathom.operators.profile import (categorical_feature_stats, class_balance, class_counts, feature_histograms,
                                      numeric_feature_stats, summary_text, target_histogram, target_summary)
from fathom.operators.replies import parse_plan, suggestions
from fathom.operators.splits import split_and_folds, stratified_kfold_assign, train_test_split
from fathom.plans.estimators import fit
from fathom.plans.runner import compare_models, run_pipeline, run_tasks
from fathom.plans.search import search
from fathom.session import build_session
from fathom.sources import csv_sink, csv_source, load_table, synthetic_alloy

__all__ = [n for n in dir() if not n.startswith("_")]
