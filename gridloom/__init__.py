"""gridloom: electrical-grid analytics and data pipelines on PySpark."""

import os

# Every core runs a worker of its own: threads inside one would only fight over the cores. Read when NumPy loads.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
