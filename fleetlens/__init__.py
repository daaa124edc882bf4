"""Fleet operations analytics as Spark jobs.

``sources``    readers, writers and upserts
``functions``  Column expressions and small Arrow kernels
``operators``  DataFrame -> DataFrame transforms
``streaming``  Structured Streaming jobs
``plans``      the operators bound to a set of tables, each with its SQL twin
"""
