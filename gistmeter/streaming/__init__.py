"""No operator here: the workload has no watermark, window, trigger or state.

The row-wise scorers (``operators.overlap.rouge``, ``operators.overlap.bleu`` and everything in
``functions``) neither shuffle nor keep state, so they also run on a streaming DataFrame as they are.
"""
