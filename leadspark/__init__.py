"""leadspark: lead scoring and customer-data matching as Spark jobs.

Sub-packages: ``sources`` (scans, lookups, sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame operators), ``plans``
(parameters, the pipeline bound to a data folder, registered queries and
their SQL twins), ``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
