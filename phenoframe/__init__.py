"""phenoframe: cohort phenotyping over event tables and free text, as Spark DataFrame plans."""

__version__ = "0.1.0"
