"""Table operators: ``DataFrame -> DataFrame``, with ``fit_*`` where data decides."""
