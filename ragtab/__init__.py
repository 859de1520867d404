"""ragtab: question/answer retrieval, judging, leaderboards, routing and chat-data
preparation as Spark DataFrame jobs.

Every public operator is ``DataFrame -> DataFrame`` and performs no action except
where noted (size checks that decide between a broadcast and a shuffle plan).
"""

__version__ = "0.1.0"
