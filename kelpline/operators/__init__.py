"""kelpline.operators"""
