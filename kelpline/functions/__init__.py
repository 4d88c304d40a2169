"""kelpline.functions"""
