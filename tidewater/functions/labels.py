"""The label dimension of scene annotations: 183 classes, things and stuff, and the groups that labels are reported in."""

from __future__ import annotations

# The published class names, in the order of their ids from 0 (unlabeled); 1 to 91 are things, 92 to 182 stuff.
CLASS_NAMES = """
    unlabeled, person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, street sign, stop sign, parking
    meter, bench, bird, cat, dog, horse, sheep, cow, elephant, bear, zebra, giraffe, hat, backpack, umbrella, shoe, eye glasses, handbag, tie,
    suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard, tennis racket, bottle, plate, wine
    glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot, hot dog, pizza, donut, cake, chair, couch, potted plant,
    bed, mirror, dining table, window, desk, toilet, door, tv, laptop, mouse, remote, keyboard, cell phone, microwave, oven, toaster, sink,
    refrigerator, blender, book, clock, vase, scissors, teddy bear, hair drier, toothbrush, hair brush, banner, blanket, branch, bridge,
    building-other, bush, cabinet, cage, cardboard, carpet, ceiling-other, ceiling-tile, cloth, clothes, clouds, counter, cupboard, curtain,
    desk-stuff, dirt, door-stuff, fence, floor-marble, floor-other, floor-stone, floor-tile, floor-wood, flower, fog, food-other, fruit,
    furniture-other, grass, gravel, ground-other, hill, house, leaves, light, mat, metal, mirror-stuff, moss, mountain, mud, napkin, net, paper,
    pavement, pillow, plant-other, plastic, platform, playingfield, railing, railroad, river, road, rock, roof, rug, salad, sand, sea, shelf,
    sky-other, skyscraper, snow, solid-other, stairs, stone, straw, structural-other, table, tent, textile-other, towel, tree, vegetable, wall-brick,
    wall-concrete, wall-other, wall-panel, wall-stone, wall-tile, wall-wood, water-other, waterdrops, window-blind, window-other, wood
"""
# Ids of things that have a name but no annotations.
MISSING = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91)
# The groups of labels, in the order of display, with their labels.
GROUPS = """
    person: person
    animal: bird, cat, dog, horse, sheep, cow, elephant, bear, zebra, giraffe
    vehicle: bicycle, car, motorcycle, airplane, bus, train, truck, boat
    outdoor: traffic light, fire hydrant, stop sign, parking meter, bench, street sign
    sports: frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard, tennis racket
    accessory: backpack, umbrella, handbag, tie, suitcase, shoe, eye glasses, hat
    appliance: microwave, oven, toaster, sink, refrigerator, blender
    electronic: tv, laptop, mouse, remote, keyboard, cell phone
    kitchen: bottle, wine glass, cup, fork, knife, spoon, bowl, plate
    food: banana, apple, sandwich, orange, broccoli, carrot, hot dog, pizza, donut, cake, food-other, vegetable, salad, fruit
    furniture: chair, couch, potted plant, bed, dining table, toilet, window, desk, mirror, door, furniture-other, stairs, light, counter, cupboard, cabinet, shelf, table
    indoor: hair brush, toothbrush, hair dryer, teddy bear, scissors, vase, clock, book
    water: water-other, waterdrops, sea, river, fog
    sky: sky-other, clouds
    plant: plant-other, straw, moss, branch, flower, leaves, bush, tree, grass
    ground: ground-other, playingfield, platform, railroad, pavement, road, gravel, dirt, snow, sand
    solid: solid-other, hill, mountain, stone, rock, wood
    building: building-other, roof, tent, brick, skyscraper, house
    structural: structural-other, railing, net, cage, fence
    wall: wall-other, wall-concrete, wall-stone, wall-brick, wall-wood, wall-panel, wall-tile
    ceiling: ceiling-other, ceiling-tile
    floor: floor-other, floor-stone, floor-marble, floor-wood, floor-tile, floor-carpet
    window: window-other, window-blind
    textile: textile-other, banner, pillow, blanket, curtain, cloth, clothes, napkin, towel, mat, rug
    raw material: metal, plastic, paper, cardboard
"""
LAST_THING, LAST_STUFF = 91, 182


def names() -> list[str]:
    """Class names by id."""
    return [n.strip() for n in CLASS_NAMES.replace("\n", " ").split(",")]


def kind(class_id: int) -> str:
    """unlabeled, thing, stuff, or unknown (missing ids, and those that no class has)."""
    if class_id == 0:
        return "unlabeled"
    if 1 <= class_id <= LAST_THING and class_id not in MISSING:
        return "thing"
    return "stuff" if LAST_THING < class_id <= LAST_STUFF else "unknown"


def groups() -> list[tuple[str, list[str]]]:
    """Groups in the order of display, each with its labels."""
    lines = [line.split(":") for line in GROUPS.strip().split("\n")]
    return [(name.strip(), [label.strip() for label in rest.split(",")]) for name, rest in lines]


def rows() -> list[tuple[int, str, str, str | None, int | None]]:
    """class_id, name, kind, group and place of the group in the order of display (null for labels without a group)."""
    place = {label: (name, k) for k, (name, labels) in enumerate(groups()) for label in labels}
    return [(i, name, kind(i), *place.get(name, (None, None))) for i, name in enumerate(names())]
