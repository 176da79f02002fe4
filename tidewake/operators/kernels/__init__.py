"""Numeric kernels, vectorised over many independent runs at once.

Arrays carry the run in their first axis, so one numpy call advances every
window of a batch; batch jobs and stream processors share these functions.
"""
